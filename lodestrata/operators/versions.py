"""Multi-version operators: visibility, newest version, tombstones, reads and scans.

Every function is lazy.  A filter on the key passes through the aggregation by key to the scan, so
put it on the result; filters on values or on op stay above it, as they must.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import prefix_filter
from ..model import DELETE, PUT, payload_columns
from ..sources.commits import written


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The versions that a snapshot sees; all without one."""
    return log if snapshot is None else log.filter(F.col("seq") <= snapshot)


def head(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key, deletes included.

    max_by combines before the shuffle, so a key with a third of all rows reaches the final
    aggregation as one row a task.  Payloads of variable width make both aggregations sort by key.
    """
    rest = ["op", *payload_columns(log)]
    newest = visible(log, snapshot).groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_row"))
    return newest.select("key", "seq", *[F.col("_row")[c].alias(c) for c in rest])


def head_by_rank(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """head() by a window; for payloads that no aggregation buffer should hold."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return visible(log, snapshot).withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live view: each key's newest version, unless that is a delete."""
    return head(log, snapshot).filter(F.col("op") == PUT).drop("op")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The live row of a key; no row where the key is missing or deleted."""
    return live(log.filter(F.col("key") == key), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each distinct key of `keys` with its live row, or nulls and found = false."""
    wanted = keys.select("key").distinct()
    hits = live(log.join(wanted, "key", "left_semi"), snapshot)
    return wanted.join(hits.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


#: monotonically_increasing_id() is the partition's number above this many bits of the row's.
_ROW_BITS = 33


def numbered(rows: DataFrame, name: str, order: list[Column] | None = None, base: int = 0) -> DataFrame:
    """Rows with consecutive numbers from base + 1, in the given order; without one as the rows come.

    Ranges of the order are sorted apart and written once, marked by range and place; the counts of
    the ranges before one, a row a range, give its offset.  Counts and numbers thus belong to the same
    ranges whatever is recomputed, and no task holds more than a range.  Rows equal in the order are
    numbered in any, but fixed, order.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = written(rows.withColumn("_mark", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_mark", _ROW_BITS)
    sizes = marked.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_offset") + 1 + base
    joined = marked.join(F.broadcast(offsets), part == F.col("_range"))  # bounded by the number of partitions
    return joined.withColumn(name, place.cast("long")).drop("_range", "_mark", "_offset")


def positioned(rows: DataFrame, descending: bool = False, name: str = "pos", by: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with their place in key order, from 1."""
    key = (by or (lambda key: key))(F.col("key"))
    return numbered(rows, name, [key.desc() if descending else key.asc()])


def scan(log: DataFrame, lo=None, hi=None, snapshot: int | None = None, reverse: bool = False, by: Callable[[Column], Column] | None = None) -> DataFrame:
    """The live rows with lo <= key < hi, in key order.

    by: another order, as an expression of the key that is compared by its own order, such as
    lambda key: F.collate(key, "UNICODE_CI").  Without one a key is compared by its bytes, and the
    bounds reach the Parquet scan.
    """
    by = by or (lambda key: key)
    rows, key = live(log, snapshot), by(F.col("key"))
    if lo is not None:
        rows = rows.filter(key >= by(F.lit(lo)))
    if hi is not None:
        rows = rows.filter(key < by(F.lit(hi)))
    return rows.orderBy(key.desc() if reverse else key)


def seek(log: DataFrame, target, snapshot: int | None = None) -> DataFrame:
    """The first live row with key >= target."""
    return scan(log, lo=target, snapshot=snapshot).limit(1)


def page(log: DataFrame, n: int, after=None, before=None, snapshot: int | None = None, by: Callable[[Column], Column] | None = None) -> DataFrame:
    """The next n live rows after a key in order, or the n rows before one in reverse order."""
    by = by or (lambda key: key)
    rows, key = live(log, snapshot), by(F.col("key"))
    if before is not None:
        return rows.filter(key < by(F.lit(before))).orderBy(key.desc()).limit(n)
    if after is not None:
        rows = rows.filter(key > by(F.lit(after)))
    return rows.orderBy(key).limit(n)


def prefix_scan(log: DataFrame, prefix, snapshot: int | None = None) -> DataFrame:
    return live(log, snapshot).filter(prefix_filter(F.col("key"), prefix)).orderBy("key")


def merge(tiers: list[DataFrame]) -> DataFrame:
    """All versions of all tiers by key, newest first; nothing is dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers).orderBy("key", F.col("seq").desc())


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, newest first."""
    return log.filter(F.col("key") == key).orderBy(F.col("seq").desc())


def head_by_tier(log: DataFrame, tier: str = "tier") -> DataFrame:
    """The first version that a search from the newest tier (smallest number) on meets."""
    rest = ["seq", "op", *[c for c in payload_columns(log) if c != tier]]
    first = log.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(F.col(tier), -F.col("seq"))).alias("_row"))
    return first.select("key", *[F.col("_row")[c].alias(c) for c in rest])


def puts_above_newest_delete(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Compatibility: every put newer than the key's newest delete; of the empty key the newest only."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    runs = visible(log, snapshot).withColumn("_deletes", F.sum(F.when(F.col("op") == DELETE, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_rank", F.row_number().over(newest))
    empty = F.length(F.col("key")) == 0
    return runs.filter((F.col("_deletes") == 0) & (F.col("op") == PUT) & (~empty | (F.col("_rank") == 1))).drop("_deletes", "_rank")


def all_puts(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Compatibility: every visible put, deleted or not."""
    return visible(log, snapshot).filter(F.col("op") == PUT)


def assign_sequence(rows: DataFrame, order: list[Column | str] | None = None, base: int = 0) -> DataFrame:
    """Consecutive seq from base + 1 in the given order, or as the rows come: a later row is newer."""
    return numbered(rows, "seq", [F.col(c) if isinstance(c, str) else c for c in order or []], base)
