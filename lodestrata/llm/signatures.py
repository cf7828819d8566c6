"""Signatures of sets such that sets of high Jaccard similarity share at least one.

If J(A, B) >= t, the two differ in at most k = (1 - t) / (1 + t) * (|A| + |B|) elements.  Elements are
dealt by hash into more than k parts, so some part is untouched: the sums of its elements' hashes
agree.  An untouched part may be empty, which tells nothing; so there are E parts more than that, and
a set with more than E empty parts is dealt again by another hash: two similar sets share a part of the
first dealing, or have both been dealt again.  What exceeds E in every dealing (of independent hashes, so
fewer by a constant factor each time) shares one signature, which stands for that.  Sizes are cut into
bands; the number of parts belongs to a band, and a set near the lower edge of a band is
also given the signatures of the band below, as its partners may lie there.
"""

from __future__ import annotations

from functools import cache
from math import ceil, floor, sqrt

import numpy as np

from .hashing import mix

RATIO = 1.35
#: Dealings of a set that has more empty parts than are spared.
DEALINGS = 6


@cache
def bands(threshold: float) -> tuple[list[int], list[tuple[int, int]]]:
    """(first size of each band, (parts, allowed empty parts) of each band)."""
    starts, shape = [1], []
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, ceil(starts[-1] * RATIO)))
    for first, after in zip(starts, starts[1:]):
        largest = after - 1
        # both sets of a pair that meets in this band have at most `partner` elements
        partner = floor(largest / threshold + 1e-9)
        most = floor((1 - threshold) / (1 + threshold) * (largest + partner) + 1e-9)
        parts, spare = most + 1, 0
        for _ in range(3):  # more parts leave more of them empty; some sets may exceed what is spared
            mean = parts * (1 - 1 / parts) ** first if parts > 1 else 0.0
            spare = ceil(mean + 2 * sqrt(mean)) if mean > 0.02 else 0
            parts = most + 1 + spare
        shape.append((parts, spare))
    return starts, shape


def _in_band(elements: np.ndarray, band: int, parts: int, spare: int) -> np.ndarray:
    out = []
    for dealing in range(DEALINGS):
        tag = (dealing << 48) + (band << 32)
        dealt = mix(elements + np.uint64(dealing)) if dealing else elements
        part = (((dealt >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, elements | np.uint64(1))
        full = np.flatnonzero(np.bincount(part, minlength=parts))
        out.append(mix(sums[full] ^ mix(full.astype(np.uint64) + np.uint64(tag))))
        if parts - len(full) <= spare:
            return np.concatenate(out)
    return np.append(np.concatenate(out), mix(np.array([(band << 32) + 0xFFFFFFFF], np.uint64)))


def full_parts(elements: np.ndarray, threshold: float) -> int:
    """How many parts of a set's first dealing, in its own band, are not empty.

    A set that is similar and not smaller has all of them but those that a difference touches, and
    shares as many signatures at least.
    """
    starts, shape = bands(threshold)
    parts = np.uint64(shape[int(np.searchsorted(starts, len(elements), side="right")) - 1][0]) if len(elements) else np.uint64(0)
    return len(np.unique(((elements >> np.uint64(32)) * parts) >> np.uint64(32)))


def signatures(elements: np.ndarray, threshold: float) -> np.ndarray:
    """Signatures of a set of mixed 64-bit hashes; none of the empty set."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64)
    starts, shape = bands(threshold)
    band = int(np.searchsorted(starts, n, side="right")) - 1
    out = [_in_band(elements, band, *shape[band])]
    # partners have at least t * n elements: those in bands below meet this set in their own band
    below = band - 1
    while below >= 0 and starts[below + 1] - 1 >= threshold * n - 1e-9:
        out.append(_in_band(elements, below, *shape[below]))
        below -= 1
    return np.concatenate(out)
