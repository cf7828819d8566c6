"""Merging runs: shadowed versions go; deletes go where nothing older can be left."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETE
from .asof import last_step
from .versions import head


def merge_runs(runs: DataFrame) -> DataFrame:
    """The newest version of each key, deletes included."""
    return head(runs)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi, seq_lo) sorted by lo -> steps of the smallest seq_lo of all ranges that cover a key."""
    open_: list[tuple] = []  # (seq_lo, hi) of ranges that have begun
    ends: list = []
    steps: list[tuple] = []

    def step(at, after: bool) -> None:
        while open_ and (open_[0][1] < at or after and open_[0][1] == at):
            heapq.heappop(open_)
        least = open_[0][0] if open_ else None
        if steps and steps[-1][:2] == (at, after):  # one step a place
            steps.pop()
        if not steps or steps[-1][2] != least:
            steps.append((at, after, least))

    kind = None
    for batch in batches:
        kind = batch.schema.field("lo").type
        for lo, hi, seq in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "seq_lo"))):
            while ends and ends[0] < lo:
                step(heapq.heappop(ends), True)
            heapq.heappush(open_, (seq, hi))
            heapq.heappush(ends, hi)
            step(lo, False)
    while ends:
        step(heapq.heappop(ends), True)
    if steps:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*steps), (kind, pa.bool_(), pa.int64()))], ["at", "after", "value"])


def coverage(files: DataFrame) -> DataFrame:
    """Steps of the smallest seq_lo among the files whose range covers a key.  A file table is a row a
    file, and is swept in one task, in memory for the ranges that overlap."""
    kind = files.schema["lo"].dataType.simpleString()
    ranges = files.select("lo", "hi", F.col("seq_lo").cast("long").alias("seq_lo")).coalesce(1).sortWithinPartitions("lo")
    return ranges.mapInArrow(_sweep, f"at {kind}, after boolean, value long")


def drop_tombstones(merged: DataFrame, remaining: DataFrame, settled: int | None = None) -> DataFrame:
    """merged without the deletes that hide nothing.

    remaining: lo, hi, seq_lo of every file outside the merge, at any level.  A delete stays where
    some such file covers its key and holds versions older than it, and where its sequence number is
    above `settled`: versions older than it may still arrive.  Puts are not moved for it; each delete
    meets the step of the file table that covers it, whatever the number of files.
    """
    deletes = last_step(merged.filter(F.col("op") == DELETE), F.col("key"), coverage(remaining), "_older")
    needed = F.coalesce(F.col("_older") < F.col("seq"), F.lit(False))
    if settled is not None:
        needed = needed | (F.col("seq") > settled)
    return merged.filter(F.col("op") != DELETE).unionByName(deletes.filter(needed).drop("_older"))


def compact(inputs: DataFrame, remaining: DataFrame, settled: int | None = None) -> DataFrame:
    return drop_tombstones(merge_runs(inputs), remaining, settled)
