"""Exact deduplication by a cuckoo-filter index of live content digests.

Texts are equal when they are identical after every character of ASCII white space is deleted.
Each task of the index owns the digests of one hash range.  It probes its cuckoo filter with a
16-bit fingerprint; a hit is verified against the key that the bucket stores, which stands for the
content: the SHA-256 of the normalised text and its length.  A miss is inserted, and a filter that
overflows is rebuilt at twice the size from the stored keys.

Scale: one scan by built-in functions writes 70 bytes a document; batches are combined before the
shuffle, so that a text which makes up a third of all rows arrives as one row a batch; the number of
shards follows the rows, so a task holds about SHARD_ROWS digests at most.  The final join goes by
digest with the split of skewed partitions that adaptive execution has.

Defined cases: a null text counts as empty; null ids come last in a tie; of rows that repeat both id
and text one stays; an empty table gives no rows; other columns are ignored by exact_dedup() and kept
by keep_one().
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, bounded_batches, documents, forget, free_name, shards_of, stored

SLOTS = 4
MAX_KICKS = 200
#: Rows of one shard of the index, about.
SHARD_ROWS = 250_000


class CuckooIndex:
    """Cuckoo filter over digests (bytes of at least 16) with the stored keys in its buckets.

    Fingerprints are 16 bits wide, 0 marks a free slot.  Each slot also holds the number of the
    entry that has the full key, so a hit is verified and the filter can be rebuilt.
    """

    def __init__(self, buckets: int = 256):
        self.entries: list[list] = []  # [key, payload...]
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.numbers = array("q", bytes(8 * SLOTS * buckets))

    def _home(self, key: bytes) -> tuple[int, int]:
        return (int.from_bytes(key[2:4], "little") or 1), int.from_bytes(key[4:12], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        # a partner that the fingerprint alone determines, so that it can be found from either side
        return bucket ^ ((mark * 0x5BD1E995 + 0x1B873593) & (self.buckets - 1) | 1)

    def __len__(self) -> int:
        return len(self.entries) - len(self.free)

    def find(self, key: bytes) -> int:
        """The slot of a key, -1 where it isn't.  A fingerprint match counts only once the stored key agrees."""
        mark, one = self._home(key)
        for bucket in (one, self._other(one, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.entries[self.numbers[slot]][0] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> list | None:
        slot = self.find(key)
        return None if slot < 0 else self.entries[self.numbers[slot]]

    def insert(self, key: bytes, *payload) -> list:
        """Insert a key that isn't there; its entry, whose payload the caller may change."""
        entry = [key, *payload]
        if self.free:
            number = self.free.pop()
            self.entries[number] = entry
        else:
            number = len(self.entries)
            self.entries.append(entry)
        if not self._place(number):
            self._resize()
        return entry

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        number = self.numbers[slot]
        self.prints[slot] = 0
        self.entries[number] = [None]
        self.free.append(number)
        return True

    def _place(self, number: int) -> bool:
        mark, bucket = self._home(self.entries[number][0])
        for kick in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.numbers[slot] = mark, number
                        return True
            bucket = self._other(bucket, mark)
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.numbers[slot], number = number, self.numbers[slot]
            bucket = self._other(bucket, mark)
        return False

    def _resize(self) -> None:
        """Rebuild from the stored keys, which stay whole whatever the filter has lost."""
        gone = set(self.free)
        while True:
            self._clear(self.buckets * 2)
            if all(self._place(i) for i in range(len(self.entries)) if i not in gone):
                return

    def live(self) -> Iterator[list]:
        return (e for e in self.entries if e[0] is not None)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_key(column: str) -> Column:
    """What stands for a text without its white space: 32 bytes of SHA-256, 8 of its length in bytes."""
    plain = F.translate(_text(column), WHITE.decode(), "")
    return F.unhex(F.concat(F.sha2(plain, 256), F.lpad(F.hex(F.octet_length(plain).cast("long")), 16, "0")))


def content_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (the key of the normalised text), n_points (code points of the original)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), content_key(text_col).alias("digest"), F.char_length(_text(text_col)).cast("long").alias("n_points"))


_GROUP = "digest binary, keep_id long, n_points long, group_size long, keep_row long, n_ties long"
_GROUP_ARROW = pa.schema([(x.split()[0], pa.binary() if "binary" in x else pa.int64()) for x in _GROUP.split(", ")])


def _fold(index: CuckooIndex, batch: pa.RecordBatch) -> None:
    """Add rows to their groups: the row that stays has the most code points, then the smallest id
    (null last), then the smallest row number; n_ties rows are like it but for that number."""
    for key, doc, points, n, row, ties in zip(*(c.to_pylist() for c in batch.columns)):
        entry = index.get(key) or index.insert(key, None, -1, 0, 0, 0)
        old, new = (-entry[2], entry[1] is None, entry[1] or 0), (-points, doc is None, doc or 0)
        if new < old:
            entry[1], entry[2], entry[4], entry[5] = doc, points, row, ties
        elif new == old:
            entry[4], entry[5] = min(entry[4], row), entry[5] + ties
        entry[3] += n


def _emit(index: CuckooIndex, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    out = list(index.live())
    for i in range(0, len(out), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + rows]), _GROUP_ARROW.types)], schema=_GROUP_ARROW)


def _combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a digest and batch: what keeps a hot digest from reaching one task row by row."""
    for batch in batches:
        index = CuckooIndex()
        _fold(index, batch)
        yield from _emit(index)


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        _fold(index, batch)
    yield from _emit(index)


def digest_groups(digests: DataFrame, n_shards: int) -> DataFrame:
    """One row a live digest of (digest, doc_id, n_points, row): keep_id, n_points and keep_row of the
    row that stays, group_size, n_ties."""
    bounded_batches(digests.sparkSession)
    one = F.lit(1).cast("long")
    rows = digests.select("digest", F.col("doc_id").alias("keep_id"), "n_points", one.alias("group_size"), F.col("row").alias("keep_row"), one.alias("n_ties"))
    return rows.mapInArrow(_combine_batches, _GROUP).repartition(n_shards, "digest").mapInArrow(_index_shard, _GROUP)


def _indexed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(digests with a number for each row, the groups of more than one row), both stored."""
    digests = stored(content_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_shards = shards_of(docs.sparkSession, digests.count(), SHARD_ROWS)
    return digests, stored(digest_groups(digests, n_shards).filter("group_size > 1"), "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest id; of rows that agree
    in both, one.
    """
    digests, copies = _indexed(docs, id_col, text_col)
    joined = digests.join(copies.drop("n_points", "n_ties"), "digest", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        size.alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup() keeps, with all their columns: one of each group of equal texts.

    Rows are recognised by text, length and id.  Where several are alike in all of these, they meet in
    an aggregation that combines before its shuffle.
    """
    digests, copies = _indexed(docs, id_col, text_col)
    forget(digests)
    names = [free_name(n, *docs.columns) for n in ("_key", "_points", "_keep_id", "_keep_points", "_ties")]
    key, points, keep_id, keep_points, ties = names
    keyed = docs.withColumn(key, content_key(text_col)).withColumn(points, F.char_length(_text(text_col)).cast("long"))
    best = copies.select(F.col("digest").alias(key), F.col("keep_id").alias(keep_id), F.col("n_points").alias(keep_points), F.col("n_ties").alias(ties))
    is_best = (F.col(points) == F.col(keep_points)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep_id))
    # a sort-merge join at every size: the groups grow with the documents
    kept = keyed.join(best.hint("merge"), key, "left").filter(F.col(ties).isNull() | (is_best & (F.col(ties) == 1))).select(*docs.columns)
    tied = best.filter(F.col(ties) > 1)
    if tied.isEmpty():
        return kept
    alike = keyed.join(tied, key).filter(is_best).groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return kept.unionByName(alike.select("_row.*"))


_LIVE = "digest binary, live long"


def _update_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    owed: dict[bytes, int] = {}  # deletions that came before their insertion in the shard's row order
    for batch in batches:
        for key, n in zip(*(c.to_pylist() for c in batch.columns)):
            n += owed.pop(key, 0)
            entry = index.get(key)
            total = n + (entry[1] if entry else 0)
            if total > 0:
                (entry or index.insert(key, 0))[1] = total
            else:
                if entry:
                    index.delete(key)
                if total < 0:
                    owed[key] = total
    out = list(index.live())
    for i in range(0, len(out), 20_000):
        keys, live = zip(*out[i : i + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(live, pa.int64())], ["digest", "live"])


def update_index(index: DataFrame | None, inserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """The index table (digest, live copies) after insertions and deletions of digests.

    inserts, deletes: frames with a digest column, a row a document.  A digest whose last live copy
    goes leaves the filter; deletions of digests that aren't live have no effect.
    """
    parts = [] if index is None else [index.select("digest", F.col("live").cast("long").alias("n"))]
    for frame, sign in ((inserts, 1), (deletes, -1)):
        if frame is not None:
            parts.append(frame.groupBy("digest").agg((F.count("*") * sign).cast("long").alias("n")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = stored(rows.filter(F.col("digest").isNotNull()), "changes")
    return rows.repartition(shards_of(rows.sparkSession, rows.count(), SHARD_ROWS), "digest").mapInArrow(_update_shard, _LIVE)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
