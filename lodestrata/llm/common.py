"""Shared plumbing of the training-data operators: scratch tables and bounded Arrow batches."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Files, scratch

#: Bytes of ASCII white space: the word separators of every operator here.
WHITE = b" \t\n\x0b\x0c\r"
#: Largest Arrow batch handed to Python, so that very long texts cannot pile up in one batch.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes; the row cap alone lets 10,000 long texts into one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "2147483647")).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        Files(df.sparkSession, df._stored_at).delete()


def drop_stored(*frames: DataFrame) -> None:
    """forget(), and let Spark clean the shuffles of finished steps (it does so when the driver
    collects its garbage)."""
    forget(*frames)
    for _ in range(2):  # what the first round frees may hold what the second does
        gc.collect()
        SparkSession.active().sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Rows of one file have numbers below this.
_FILE_ROWS = 1 << 40


def row_numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row that is the same in every read.

    Rows of files, read as they are, are numbered by file and place in the file, so nothing is
    written: the files' names, a row a file, are all that is collected.  Other rows are stored once.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    path = free_name("_path", *df.columns, name)
    names = sorted(r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect())
    at = free_name("_at", *df.columns, name)
    table = df.sparkSession.createDataFrame([(n, i * _FILE_ROWS) for i, n in enumerate(names)], f"{path} string, {at} long")
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    return placed.join(F.broadcast(table), path).withColumn(name, F.col(name) + F.col(at)).select(*df.columns, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shards(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_of(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions such that each has about `most` of the rows, and at least as many as shuffles have."""
    return max(shards(spark), -(-rows // most))


def free_name(name: str, *taken: str) -> str:
    """A column name that isn't taken."""
    while name in taken:
        name += "_"
    return name
