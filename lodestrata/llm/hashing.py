"""Vectorised word hashing over Arrow text buffers.

Words are the runs of bytes outside ASCII white space, with A-Z lower-cased.  A word's hash is a
polynomial over its bytes in arithmetic modulo 2**64, finished with a mixing step.  All work is in
numpy over pieces of about a megabyte that are cut at white space, so that a text of any length
needs memory for one piece and for its hashes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(65, 91):
    _CODE[_c] = _CODE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE[_SPACE] = 0
_POWER = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWER = np.cumprod(steps, dtype=np.uint64)
    return _POWER


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offsets


def _pieces(values: np.ndarray, start: int, stop: int):
    """Cut values[start:stop] at white space into pieces of about PIECE bytes."""
    while stop - start > PIECE:
        at = start + PIECE
        while at < stop:
            white = np.flatnonzero(_SPACE[values[at : min(stop, at + PIECE)]])
            if len(white):
                at += int(white[0])
                break
            at = min(stop, at + PIECE)
        yield start, at
        start = at
    if stop > start:
        yield start, stop


def _hash_piece(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one piece; cuts: where documents start in it."""
    solid = ~_SPACE[part]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = cuts[cuts < len(part)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    spans = np.diff(np.append(starts, len(part)))
    place = np.arange(starts[0], len(part)) - np.repeat(starts, spans)
    body = part[starts[0] :]
    code = _CODE[body] * _powers(int(spans.max()))[place]
    return mix(np.add.reduceat(code, starts - starts[0])), starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    values, offsets = text_buffer(column)
    counts = np.zeros(len(column), np.int64)
    found = []
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        j = min(j, len(column))
        if j == i + 1:
            for a, b in _pieces(values, int(offsets[i]), int(offsets[j])):
                hashes, _ = _hash_piece(values[a:b], np.zeros(0, np.int64))
                counts[i] += len(hashes)
                found.append(hashes)
        else:
            a = int(offsets[i])
            hashes, starts = _hash_piece(values[a : int(offsets[j])], offsets[i:j] - a)
            edges = np.searchsorted(starts, offsets[i : j + 1] - a)
            counts[i:j] = np.diff(edges)
            found.append(hashes)
        i = j
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of `size` words; of a text with
    fewer words one hash of them all; of a text without words none."""
    words, counts = word_hashes(column)
    edges = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(len(words), np.uint64)
    for k in range(size):
        shifted = np.zeros(len(words), np.uint64)
        shifted[: len(words) - k] = words[k:] if k else words
        grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + shifted)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            one = np.array([short], np.uint64)
            for w in words[a:b]:
                one = mix(one * np.uint64(0xA24BAED4963EE407) + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
