"""Files by their key ranges: which can hold a key, a range or other files; Bloom filters as rows.

A file table has a row a file: file, lo, hi (smallest and largest key), and whatever else the caller
keeps.  These functions plan; they read file tables, which are small, and never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_step


def file_table(log: DataFrame, *by: str) -> DataFrame:
    """lo, hi, seq_lo, seq_hi, n_rows, n_bytes of each file that the columns `by` name."""
    size = F.octet_length(F.col("key")) + 9
    return log.groupBy(*by).agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("seq").alias("seq_lo"), F.max("seq").alias("seq_hi"),
        F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("n_bytes"),
    )


def may_hold(files: DataFrame, key) -> DataFrame:
    """The files whose range covers a key."""
    return files.filter((F.col("lo") <= key) & (F.col("hi") >= key))


def overlaps(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def overlapping(files: DataFrame, lo, hi) -> DataFrame:
    """The files that share a key range with [lo, hi]."""
    return files.filter(overlaps(F.col("lo"), F.col("hi"), F.lit(lo), F.lit(hi)))


def find_file(files: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the file of a disjoint level that could hold it: the first with hi >= key."""
    by_hi = Window.orderBy("hi")  # a row a file
    begins = files.select(F.lag("hi").over(by_hi).alias("at"), F.lit(True).alias("after"), F.struct("file", "lo").alias("value"))
    ends = files.groupBy().agg(F.max("hi").alias("at")).filter("at is not null").select("at", F.lit(True).alias("after"), F.lit(None).cast(begins.schema["value"].dataType).alias("value"))
    found = last_step(keys.select("key"), F.col("key"), begins.union(ends), "_file")
    file = F.col("_file.file")
    return found.select("key", file.alias("file"), (file.isNotNull() & F.coalesce(F.col("_file.lo") <= F.col("key"), F.lit(False))).alias("in_range"))


def approximate_offset(files: DataFrame, key) -> DataFrame:
    """Bytes of the files that lie wholly below a key."""
    return files.agg(F.coalesce(F.sum(F.when(F.col("hi") < key, F.col("n_bytes"))), F.lit(0)).cast("long").alias("offset"))


def bloom_shape(n_keys: Column, bits_per_key: int = 10) -> tuple[Column, int]:
    """(bits of the filter, probes a key)."""
    return F.greatest(F.lit(64), n_keys * bits_per_key).cast("long"), max(1, min(30, int(bits_per_key * 0.69)))


def _positions(key: Column, bits: Column, probes: int) -> Column:
    one, two = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    # each step in a 40-bit range, so that sums stay far from overflow
    a, b = F.pmod(one, F.lit(1 << 40)), F.pmod(two, F.lit(1 << 40))
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.pmod(a + i * b, bits))


def bloom_build(keys: DataFrame, *by: str, bits_per_key: int = 10) -> DataFrame:
    """The set bits of a filter for each group: by, bits, bit."""
    distinct = keys.select(*by, "key").distinct()
    sizes = distinct.groupBy(*by).agg(F.count("*").alias("n_keys"))
    bits, probes = bloom_shape(F.col("n_keys"), bits_per_key)
    return distinct.join(sizes.withColumn("bits", bits), list(by)).select(*by, "bits", F.explode(_positions(F.col("key"), F.col("bits"), probes)).alias("bit")).distinct()


def bloom_probe(filters: DataFrame, keys: DataFrame, *by: str, bits_per_key: int = 10) -> DataFrame:
    """by, key, maybe: whether every probed bit of a group's filter is set."""
    _, probes = bloom_shape(F.lit(1), bits_per_key)
    shape = filters.select(*by, "bits").distinct()
    asked = keys.select(*by, "key").distinct().join(shape, list(by), "left")
    spots = asked.select(*by, "key", F.explode_outer(_positions(F.col("key"), F.col("bits"), probes)).alias("bit"))
    hit = spots.join(filters.select(*by, "bit", F.lit(1).alias("_set")), [*by, "bit"], "left")
    return hit.groupBy(*by, "key").agg(F.coalesce(F.bool_and(F.col("_set").isNotNull()), F.lit(False)).alias("maybe"))
