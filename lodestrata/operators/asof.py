"""The last step at or below each key: how rows meet files without comparing every row with every file.

A step table says what holds from a key on: at (null: from the start), after (whether only above keys
equal to `at`), value; one step a place.  It has a few rows a file.  Rows and steps are dealt into cells of the key
order, whose bounds come from the step table, and one window over each sorted cell carries the last
step on.  A cell begins with the step that holds when it starts, so cells need nothing of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(key: Column, bounds: list, first: int = 0) -> Column:
    """How many bounds are <= key, by a binary search that generated code does."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _cell(key, bounds[:mid], first)).otherwise(_cell(key, bounds[mid + 1 :], first + mid + 1))


def last_step(rows: DataFrame, key: Column, steps: DataFrame, name: str) -> DataFrame:
    """Rows with the value of the last step that holds at their key, null where none does."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["at", "after"]  # a table of a few rows a file: one sorted task, as in all planning
    by_at = Window.orderBy(F.col("at").asc_nulls_first(), "after")
    cut = steps.filter("at is not null").withColumn("_n", F.ntile(n).over(Window.orderBy(*order)))
    bounds = sorted({r[1] for r in cut.groupBy("_n").agg(F.min("at")).collect()})[1:]  # fewer than n
    bounds = [bytearray(b) if isinstance(b, (bytes, bytearray)) else b for b in bounds]
    place = lambda k: F.when(k.isNull(), 0).otherwise(_cell(k, bounds))
    held = F.struct("value").alias("_held")
    dealt = steps.select(place(F.col("at")).alias("_cell"), F.col("at").alias("_key"), F.when(F.col("after"), 2).otherwise(0).alias("_turn"), held, F.lag(F.struct("value")).over(by_at).alias("_before"))
    first = F.row_number().over(Window.partitionBy("_cell").orderBy(F.col("_key").asc_nulls_first(), "_turn"))
    opening = dealt.withColumn("_first", first).filter("_first = 1 and _before is not null").select("_cell", F.lit(None).cast(steps.schema["at"].dataType).alias("_key"), F.lit(-1).alias("_turn"), F.col("_before").alias("_held"))
    own = rows.select(place(key).alias("_cell"), key.alias("_key"), F.lit(1).alias("_turn"), F.struct("*").alias("_row"))
    everything = own.unionByName(dealt.drop("_before").unionByName(opening), allowMissingColumns=True)
    carried = F.last("_held", ignorenulls=True).over(Window.partitionBy("_cell").orderBy(F.col("_key").asc_nulls_first(), "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return everything.withColumn("_held", carried).filter("_row is not null").select("_row.*", F.col("_held.value").alias(name))
