"""Key comparison, prefixes, packing, and bounds that planning computes on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, a shorter prefix first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def prefix_filter(key: Column, prefix: str | bytes) -> Column:
    """Whether a key starts with a prefix; reaches the Parquet scan for strings and bytes."""
    if isinstance(prefix, str):
        return key.startswith(prefix)
    upper = prefix_upper_bound(prefix)
    above = key >= F.lit(bytearray(prefix))
    return above if upper is None else above & (key < F.lit(bytearray(upper)))


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The least bytes above every key with the prefix; None where there is no bound."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def shortest_separator(low: bytes, high: bytes) -> bytes:
    """Some short bytes s with low <= s < high, for low < high; low where none is shorter."""
    same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    if same < min(len(low), len(high)) and low[same] < 0xFF and low[same] + 1 < high[same]:
        return low[:same] + bytes([low[same] + 1])
    return low


def short_successor(key: bytes) -> bytes:
    """Some short bytes >= key: the first byte below 0xff raised, the rest dropped."""
    for i, b in enumerate(key):
        if b != 0xFF:
            return key[:i] + bytes([b + 1])
    return key


def pack(seq: Column, op: Column) -> Column:
    """Sequence and op in one LONG."""
    return F.shiftleft(seq.cast("long"), 8) + op.cast("long")


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 8), packed.bitwiseAND(F.lit(255)).cast("tinyint")


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share at their beginning."""
    upto = F.least(F.length(a), F.length(b))
    return F.when(upto == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative LONG in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


_CRC32C_POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli, reflected
_MASK_DELTA = 0xA282EAD8  # fixed value: added to a rotated checksum


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_CRC32C_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _crc_table()


def crc32c(data: bytes, start: int = 0) -> int:
    c = start ^ 0xFFFFFFFF
    for byte in data:
        c = _TABLE[(c ^ byte) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def mask_crc(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    rotated = (masked - _MASK_DELTA) & 0xFFFFFFFF
    return (rotated >> 17 | rotated << 15) & 0xFFFFFFFF


# --- hashes of columns: loops over bytes, which no built-in function has, over many rows at once ---


def _by_width(data: pd.Series, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """of(bytes as a padded matrix, lengths) over rows of like lengths, at most 4 MB at a time."""
    found = np.zeros(len(data), np.int64)
    known = np.flatnonzero(data.notna().to_numpy())
    sizes = np.array([len(data.iloc[i]) for i in known], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        some = 1
        while at + some < len(order) and (some + 1) * sizes[order[at + some]] <= 4 << 20 and some < 4096:
            some += 1
        rows = order[at : at + some]
        n = sizes[rows]
        body = np.zeros((some, int(n.max()) + 4), np.uint8)
        for j, r in enumerate(rows):
            body[j, : n[j]] = np.frombuffer(data.iloc[known[r]], np.uint8)
        found[known[rows]] = of(body, n)
        at += some
    return pd.Series(found).where(data.notna().to_numpy(), None).astype("Int64")


def _crc_rows(body: np.ndarray, n: np.ndarray) -> np.ndarray:
    table, c = np.array(_TABLE, np.uint32), np.full(len(body), 0xFFFFFFFF, np.uint32)
    for i in range(int(n.max())):
        on = i < n
        c[on] = table[(c[on] ^ body[on, i]) & 255] ^ (c[on] >> np.uint32(8))
    return (c ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


# fixed values of the public 32-bit Murmur3 hash
_MULTIPLIERS = (0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35)
_ADDED = 0xE6546B64


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _murmur_rows(body: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    one, two, three, four = (np.uint32(m) for m in _MULTIPLIERS)
    h = np.full(len(body), seed & 0xFFFFFFFF, np.uint32)
    words = body[:, : body.shape[1] // 4 * 4].copy().view("<u4")
    for i in range(words.shape[1]):
        k = _turned(words[:, i] * one, 15) * two  # bytes behind the end are 0 and leave the state
        h = np.where(4 * i < n, h ^ k, h)
        h = np.where(4 * i + 4 <= n, _turned(h, 13) * np.uint32(5) + np.uint32(_ADDED), h)
    h ^= n.astype(np.uint32)
    for shift, by in ((16, three), (13, four)):
        h = (h ^ (h >> np.uint32(shift))) * by
    return (h ^ (h >> np.uint32(16))).astype(np.int64)


def _hashed(data: Column, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    def run(column: pd.Series) -> pd.Series:  # made in the call: without a session no type is parsed
        return _by_width(column, of)

    return F.pandas_udf(run, "long")(data)


def crc32c_column(data: Column) -> Column:
    """crc32c() of a BINARY column."""
    return _hashed(data, _crc_rows)


def murmur3(data: Column, seed: int) -> Column:
    """The public 32-bit Murmur3 hash of a BINARY column, as a LONG; Spark's hash() has other tails."""
    return _hashed(data, lambda body, n: _murmur_rows(body, n, seed))


def mask_crc_column(crc: Column) -> Column:
    """mask_crc() of a LONG column."""
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (turned + F.lit(_MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))
