"""Level policy over file tables (file, level, lo, hi, n_bytes): what to compact, with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_step

LEVELS = 7
#: Files of level 0, and bytes of level 1 (ten times as many in each level below), that are full.
LEVEL0_FILES = 4
LEVEL1_BYTES = 10 << 20


def level_capacity(level: int) -> int:
    return LEVEL1_BYTES * 10 ** (level - 1)


def level_scores(files: DataFrame) -> DataFrame:
    """level, n_files, n_bytes, score of all levels but the last; a score of 1 is due."""
    sums = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("n_bytes").cast("long").alias("n_bytes"))
    full = F.lit(float(LEVEL1_BYTES)) * F.pow(F.lit(10.0), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / LEVEL0_FILES).otherwise(F.col("n_bytes") / full)
    return sums.filter(F.col("level") < LEVELS - 1).withColumn("score", score)


def islands(files: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Files with the island of transitively overlapping ranges that each belongs to."""
    by_lo = Window.orderBy(lo, "file")
    before = by_lo.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col(lo) > F.max(hi).over(before)).cast("int"), F.lit(1))
    return files.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(by_lo).cast("long")).drop("_fresh")


def closure(files: DataFrame, seed) -> DataFrame:
    """All files that overlap a seed file, or a file that overlaps it, and so on."""
    marked = islands(files)
    return marked.join(marked.filter(F.col("file") == seed).select("island"), "island", "left_semi")


def overlapping_files(inputs: DataFrame, others: DataFrame) -> DataFrame:
    """The files of `others` whose range meets that of some input.

    Of the inputs that begin at or below a file's end, the one that reaches farthest decides.
    """
    reach = F.max("hi").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = inputs.groupBy("lo").agg(F.max("hi").alias("hi")).select(F.col("lo").alias("at"), F.lit(False).alias("after"), reach.alias("value"))
    return last_step(others, F.col("hi"), steps, "_reach").filter("_reach >= lo").drop("_reach")


def next_by_pointer(files: DataFrame, pointer: Column) -> DataFrame:
    """The file after the pointer in key order, else the first: the round of a level."""
    return files.orderBy((F.col("hi") > pointer).cast("int").desc(), "lo").limit(1)
