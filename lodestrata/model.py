"""Mutations: one row is one version of one key.

key    STRING (compared by its UTF-8 bytes) or BINARY; both order by unsigned bytes
seq    LONG from 1, unique for a key; the newest version has the largest
op     TINYINT, 1 put and 0 delete
more   payload columns of any type, null in deletes
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
MAX_SEQ = 2**56 - 1
KEY_WIDTH = 10


def key_of(column: str | Column, width: int = KEY_WIDTH) -> Column:
    """A fixed-width key whose byte order is the order of the non-negative ids."""
    return F.lpad((F.col(column) if isinstance(column, str) else column).cast("string"), width, "0")


def payload_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("key", "seq", "op")]


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as mutations of their users: an error deletes, everything else puts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    put = F.col("event_type") != "error"
    return events.select(
        key_of("user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        put.cast("tinyint").alias("op"),
        F.when(put, F.col("event_type")).alias("event_type"),
        F.when(put, F.col("value")).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as mutations of their customers: a filled order deletes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    put = F.col("o_orderstatus") != "F"
    return orders.select(
        key_of("o_custkey").alias("key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        put.cast("tinyint").alias("op"),
        F.when(put, F.col("o_totalprice")).alias("price"),
    )
