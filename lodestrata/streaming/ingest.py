"""Streams of mutations into a store, and their state without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..model import payload_columns
from ..sources.store import Store


def stream_ingest(mutations: DataFrame, store: Store, name: str, checkpoint: str, order: list | None = None, maintain: bool = True) -> DataStreamWriter:
    """A writer that commits each micro-batch of (key, op, payload...[, seq]) once.

    A batch that is delivered again after a failure has its number in the manifest and is skipped.  Rows
    that carry seq may arrive late or out of order; seq decides what is newest.  Compaction, which is
    the back pressure, runs between batches.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.write(batch, order, stream=(name, batch_id))
        if maintain:
            store.maintain()

    return mutations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def latest_by_key(mutations: DataFrame) -> DataFrame:
    """The newest version of each key of a stream, for the complete and update modes."""
    rest = ["op", *payload_columns(mutations)]
    newest = mutations.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_row"))
    return newest.select("key", "seq", *[F.col("_row")[c].alias(c) for c in rest])
