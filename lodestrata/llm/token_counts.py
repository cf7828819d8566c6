"""Token counts as delta-maintained rollups.

The store keeps signed rows (one for each insertion, -1 for what a deletion or revision takes back)
and additive totals by source, language and tokenizer version.  A batch reads the live rows of the
keys that it names, turns its changes into signed rows, adds their sums to the totals and becomes
visible by one commit file, which appears whole and which one writer alone can create; the loser
reads on and tries again in folders of its own.  A batch id that is committed already has no effect,
so a batch may be delivered any number of times.

Scale: the ledger is written in ranges of doc_id.  A batch reads it within the bounds of its own ids
(which prune files and row groups) and semi-joins it to its own keys before anything is summed, so
work goes with the batch and the keys that it touches.  Totals are sums, combined before the shuffle:
a source with a third of all rows is a few rows a task.  Commits are checkpointed, so a reader opens
CHECKPOINT_EVERY of them at most; batch ids are remembered for the last KNOWN_BATCHES batches.
Ledger files are never rewritten but by compact(), which replaces them by their live sums.

Defined cases: null source or lang form groups of their own; null counts count as 0; an insertion of
a live key counts as a revision; a deletion or revision of a key that isn't live has no effect, but a
revision inserts where it names source and lang; within one batch the last change of a key by the
column that `order` names (then by op, count) holds, repeated rows count once; rows with null doc_id
or tokenizer, or another op, are ignored; other columns, whatever their names, are ignored; a null
text counts as empty, and texts of any length are counted whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, Files, scratch
from .bpe import token_counter
from .common import bounded_batches, documents, stored

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
CHECKPOINT_EVERY = 20
KNOWN_BATCHES = 10_000
_LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class State:
    """What the commits up to a version say: ledger folders, the folder of totals, known batch ids."""

    def __init__(self) -> None:
        self.version, self.ledger, self.totals, self.batches = 0, [], None, {}

    def apply(self, version: int, entry: dict) -> None:
        self.version = version
        self.ledger = entry["ledger"] if entry["replaces"] else self.ledger + entry["ledger"]
        self.totals = entry["totals"]
        self.batches |= dict.fromkeys(entry["batches"])
        for old in list(self.batches)[:-KNOWN_BATCHES]:
            del self.batches[old]


class RollupStore:
    """A rollup under a folder: _manifest/<version>.json, ledger/<unique>, totals/<unique>."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._log = CommitLog(Files(spark, self.path))

    def state(self) -> State:
        """The last version, from its last checkpoint on; small files, read on the driver, never data."""
        found, state = self._log.versions(), State()
        start = next((i for i in range(len(found) - 1, -1, -1) if self._log.read(found[i])["replaces"]), 0)
        for v in found[start:]:
            state.apply(v, self._log.read(v))
        return state

    def _commit(self, state: State, batches: list[str], ledger: list[str], totals: str | None, replaces: bool = False) -> bool:
        """Whether this became the next version; False where another writer's commit did."""
        version = state.version + 1
        if version % CHECKPOINT_EVERY == 0:  # says all there is, and so is a checkpoint
            batches = [*state.batches, *batches]
            ledger, replaces = ledger if replaces else state.ledger + ledger, True
        return self._log.commit(version, {"batches": batches, "ledger": ledger, "totals": totals, "replaces": replaces})

    def ledger(self, state: State | None = None) -> DataFrame:
        """All signed rows that count."""
        state = state or self.state()
        paths = [f"{self.path}/{folder}" for folder in state.ledger]
        return self.spark.read.schema(_LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], _LEDGER)

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        names = ["doc_id", "source", "lang", "tokenizer"]
        sums = rows.groupBy(*names).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs > 0").select(*names, "tokens")

    def live(self, state: State | None = None) -> DataFrame:
        """The live rows: doc_id, source, lang, tokenizer, tokens."""
        return self._sums(self.ledger(state))

    def live_of(self, changes: DataFrame, state: State) -> DataFrame:
        """The live rows of the keys of a batch."""
        low, high = changes.agg(F.min("doc_id"), F.max("doc_id")).first()
        near = self.ledger(state).filter(F.col("doc_id").between(low, high)) if low is not None else self.ledger(state).limit(0)
        return self._sums(near.join(changes.select(*KEY), KEY, "left_semi"))

    def totals(self, state: State | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens after the last commit."""
        state = state or self.state()
        if state.totals is None:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/{state.totals}")

    def _changes(self, changes: DataFrame, order: str | None) -> DataFrame:
        """The change that holds of each key."""
        names = ["doc_id", "source", "lang", "tokenizer"]
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in names[1:]], F.col("op"),
            F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), (F.col(order) if order else F.lit(0)).alias("_order"),
        )
        rows = rows.filter("doc_id is not null and tokenizer is not null and op in ('insert', 'revise', 'delete')")
        last = rows.groupBy(*KEY).agg(F.max(F.struct("_order", "op", "tokens", "source", "lang")).alias("c"))
        return stored(last.select(*KEY, "c.op", "c.tokens", "c.source", "c.lang"), "changes")

    def apply(self, batch_id: str, changes: DataFrame, order: str | None = None) -> bool:
        """Apply changes (doc_id, source, lang, tokenizer, op, tokens) once; False where the batch id
        is committed already.  op: insert, revise or delete; order names a column of changes."""
        state = self.state()
        if batch_id in state.batches:
            return False
        new = self._changes(changes, order)
        while True:
            if not state.ledger:  # nothing is live yet: no join
                delta = new.filter("op = 'insert' or op = 'revise' and (source is not null or lang is not null)").select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("long").alias("docs"), "tokens")
            else:
                delta = self._delta(new, self.live_of(new, state))
            ledger, totals = f"ledger/{uuid.uuid4().hex}", f"totals/{uuid.uuid4().hex}"
            delta.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/{ledger}")
            added = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/{ledger}").groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            sums = self.totals(state).unionByName(added).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            sums.filter("n_docs <> 0").write.parquet(f"{self.path}/{totals}")
            if self._commit(state, [batch_id], [ledger], totals):
                return True
            state = self.state()  # another writer was faster
            if batch_id in state.batches:
                return False

    @staticmethod
    def _delta(new: DataFrame, live: DataFrame) -> DataFrame:
        """The signed rows that changes make of the live rows of their keys."""
        old = live.select(*[F.col(c).alias(f"old_{c}") for c in ("doc_id", "tokenizer", "source", "lang", "tokens")])
        both = new.join(old, (F.col("doc_id") == F.col("old_doc_id")) & (F.col("tokenizer") == F.col("old_tokenizer")), "left")
        was = F.col("old_doc_id").isNotNull()
        take = F.when(was, F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens")))
        named = lambda c: F.when(was & (F.col("op") == "revise"), F.coalesce(c, f"old_{c}")).otherwise(F.col(c)).alias(c)
        give = F.when(
            (F.col("op") != "delete") & (was | F.col("source").isNotNull() | F.col("lang").isNotNull() | (F.col("op") == "insert")),
            F.struct(named("source"), named("lang"), F.lit(1).cast("long").alias("docs"), F.col("tokens")),
        )
        return both.select(*KEY, F.explode(F.filter(F.array(take, give), lambda x: x.isNotNull())).alias("d")).select("doc_id", "d.source", "d.lang", "tokenizer", "d.docs", "d.tokens")

    def compact(self) -> bool:
        """Replace all ledger files by their live rows; totals stay.  False where a writer was faster."""
        state = self.state()
        if not state.ledger:
            return False
        ledger = f"ledger/{uuid.uuid4().hex}"
        rows = self.live(state).select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("long").alias("docs"), "tokens")
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/{ledger}")
        return self._commit(state, list(state.batches), [ledger], state.totals, replaces=True)


BPE = "byte_bpe_50k"
PLAIN = ("bytes-1", "words-1")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens under two tokenizers that need no vocabulary:
    bytes-1 (UTF-8 bytes) and words-1 (runs outside ASCII white space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    both = F.array(F.struct(F.lit("bytes-1").alias("tokenizer"), F.octet_length(text).cast("long").alias("tokens")), F.struct(F.lit("words-1").alias("tokenizer"), words.alias("tokens")))
    return docs.select("doc_id", "source", "lang", F.explode(both).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.tokens")


def counted_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens under the byte-level tokenizer of bpe.py."""
    bounded_batches(docs.sparkSession)
    counter = token_counter(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            n = [count(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([BPE] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def _rolled_up(spark: SparkSession, sf_dir: str, exact: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Totals after three batches over all documents: an estimate a document from the column n_chars,
    its revision by counts of the whole texts (delivered twice), and the deletion of what the labels
    call low quality."""
    store = RollupStore(spark, scratch(spark, "rollup"))
    names = F.explode(F.array(*[F.lit(v) for v in versions])).alias("tokenizer")
    first = documents(spark, sf_dir).select("doc_id", "source", "lang", names, F.lit("insert").alias("op"), F.coalesce(F.col("n_chars"), F.lit(0)).alias("tokens"))
    store.apply("estimates", first)
    exact = exact.withColumn("op", F.lit("revise"))
    store.apply("counts", exact)
    store.apply("counts", exact)
    poor = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), names, F.lit("delete").alias("op"), F.lit(0).alias("tokens"))
    store.apply("removals", poor)
    return store.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup by tokens of the byte-level tokenizer, bytes and words."""
    docs = documents(spark, sf_dir)
    return _rolled_up(spark, sf_dir, counted(docs).unionByName(counted_bpe(docs)), (*PLAIN, BPE))


def rollup_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup by what SQL can count, to be held against it."""
    return _rolled_up(spark, sf_dir, counted(documents(spark, sf_dir)), PLAIN)


#: Of rollup_plain; the tokens of the byte-level tokenizer have no SQL.
ORACLE = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS text FROM documents
           WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)),
c AS (SELECT source, lang, 'bytes-1' AS tokenizer, octet_length(encode(text)) AS tokens FROM d
      UNION ALL
      SELECT source, lang, 'words-1', len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""
