"""Key functions on the driver and as columns."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import keys as K


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_separator_lies_between(a, b):
    low, high = sorted((a, b))
    if low < high:
        s = K.shortest_separator(low, high)
        assert low <= s < high and len(s) <= len(low)


@given(st.binary(max_size=6), st.binary(max_size=4))
def test_successor_and_prefix_bound(key, tail):
    assert K.short_successor(key) >= key
    bound = K.prefix_upper_bound(key)
    assert bound is None and not key.strip(b"\xff") or key + tail < bound


def test_prefix_bound_has_nothing_between():
    assert K.prefix_upper_bound(b"ab") == b"ac"
    assert K.prefix_upper_bound(b"a\xff") == b"b"
    assert K.prefix_upper_bound(b"\xff\xff") is None


def test_crc32c():
    assert K.crc32c(b"123456789") == 0xE3069283
    assert K.crc32c(b"6789", K.crc32c(b"12345")) == 0xE3069283
    assert K.unmask_crc(K.mask_crc(0xE3069283)) == 0xE3069283 != K.mask_crc(0xE3069283)


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_columns(spark, _):
    rows = [("abc", "abd", 5, 1), ("", "x", 127, 0), ("same", "same", 128, 1), ("é", "e", 16384, 1)]
    df = spark.createDataFrame(rows, "a string, b string, n bigint, op tinyint")
    seq, op = K.unpack(F.col("p"))
    got = df.withColumn("p", K.pack(F.col("n"), F.col("op"))).select(
        K.compare(F.col("a"), F.col("b")), K.shared_prefix_length(F.col("a"), F.col("b")), K.varint_length(F.col("n")), seq, op
    )
    assert [tuple(r) for r in got.collect()] == [(-1, 2, 1, 5, 1), (-1, 0, 1, 127, 0), (0, 4, 2, 128, 1), (1, 0, 3, 16384, 1)]


def test_binary_prefix(spark):
    keys = [b"a", b"a\xff", b"a\xff\x01", b"b", b"\xff", b"\xff\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for p in (b"a", b"a\xff", b"\xff", b""):
        got = sorted(bytes(r[0]) for r in df.filter(K.prefix_filter(F.col("key"), p)).collect())
        assert got == sorted(k for k in keys if k.startswith(p))


def test_hashes_of_columns(spark):
    import random

    def murmur(d, seed):  # as published
        m, h = 0xFFFFFFFF, seed
        for i in range(0, len(d), 4):
            k = int.from_bytes(d[i : i + 4], "little") * 0xCC9E2D51 & m
            k = ((k << 15) | (k >> 17)) * 0x1B873593 & m
            h ^= k
            if i + 4 <= len(d):
                h = (((h << 13) | (h >> 19)) & m) * 5 + 0xE6546B64 & m
        h ^= len(d)
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return h ^ h >> 16

    rnd = random.Random(3)
    data = [bytearray(rnd.randbytes(n)) for n in [*range(30), 5_000_000]] + [None, bytearray(b"123456789")]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    for r in df.select("d", K.crc32c_column(F.col("d")).alias("c"), K.murmur3(F.col("d"), 99).alias("m")).filter("d is null or length(d) < 99").collect():
        if r["d"] is None:
            assert r["c"] is None and r["m"] is None
        else:
            assert r["c"] == K.crc32c(bytes(r["d"])) and r["m"] == murmur(bytes(r["d"]), 99)
