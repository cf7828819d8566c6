"""Chat formatting with cumulative-snapshot collapse.

A chat log that is written after every turn holds each conversation many times, every copy a
prefix of the next.  A rolling hash over the turns (the exclusive or of a 128-bit hash of each turn
with its position, so that the hash of a prefix follows from the one before by one step) names every
turn prefix.  A conversation whose whole hash is another's proper prefix is dropped by an anti-join,
of equal conversations the smallest id stays, and what remains is rendered.

Scale: only built-in functions.  Windows go by conversation and spill; prefix hashes are made
distinct before the anti-join, so a first turn that every conversation has is one row on each side.
Texts are shuffled once, for the windows, and those of dropped conversations are never gathered.

Defined cases: turns are ordered by turn (nulls first), role, text; a null role or text counts as
empty; repeated rows are repeated turns; a conversation with null id is one conversation of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How a turn is written: role and text between markers.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _hashed(conversations: DataFrame) -> DataFrame:
    """The turns with position, and the rolling hashes (a, b) of the prefix that each ends."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = turns.withColumn("pos", F.row_number().over(order))
    for name, seed in (("a", 1), ("b", 2)):
        place = place.withColumn(name, F.expr(f"bit_xor(xxhash64({seed}, pos, role, text))").over(so_far))
    return place.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")).cast("long"))


def collapse(conversations: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, n_turns, keep_id (smallest id of its equals), n_copies,
    kept (it is the first of its equals, and no proper prefix of another)."""
    rolled = _hashed(conversations).select("conv_id", "pos", "n_turns", "a", "b")
    whole = rolled.filter("pos = n_turns").select("conv_id", "n_turns", "a", "b")
    inner = rolled.filter("pos < n_turns").select("a", "b", F.col("pos").cast("long").alias("n_turns")).distinct()
    groups = whole.groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("keep_id"), F.count("*").cast("long").alias("n_copies"))
    prefixes = inner.withColumn("is_prefix", F.lit(True))
    verdicts = groups.join(prefixes, ["a", "b", "n_turns"], "left")
    return whole.join(verdicts, ["a", "b", "n_turns"]).select(
        "conv_id", "n_turns", "keep_id", "n_copies", (F.col("conv_id").eqNullSafe(F.col("keep_id")) & F.col("is_prefix").isNull()).alias("kept")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """One row a maximal conversation: conv_id, n_turns, n_copies."""
    rolled = _hashed(conversations).select("conv_id", "pos", "n_turns", "a", "b")
    inner = rolled.filter("pos < n_turns").select("a", "b", F.col("pos").cast("long").alias("n_turns")).distinct()
    groups = rolled.filter("pos = n_turns").groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").cast("long").alias("n_copies"))
    return groups.join(inner, ["a", "b", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, n_copies, rendered."""
    keep = maximal(conversations).select(F.col("conv_id").alias("keep_id"), "n_turns", "n_copies")
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).join(keep, F.col("conv_id").eqNullSafe(F.col("keep_id")))
    head, mid, tail = TURN.split("{role}")[0], TURN.split("{role}")[1].split("{text}")[0], TURN.split("{text}")[1]
    line = lambda x: F.concat(F.lit(head), x["role"], F.lit(mid), x["text"], F.lit(tail))
    return (
        turns.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("rendered"))
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rendered
  FROM conversations GROUP BY conv_id),
g AS (SELECT turns, n_turns, rendered, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns, rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM g
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > g.n_turns AND c.turns[1] = g.turns[1] AND c.turns[1:g.n_turns] = g.turns)
"""
