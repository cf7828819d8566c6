"""Katz backoff language model over word bigrams.

P(w | h) = d(c) * c / c(h) for bigrams that training has c times, else alpha(h) * P(w).  d(c) are the
Good-Turing discounts of counts up to 5, alpha(h) gives exactly the mass that discounting left to the
words that h was not seen with, so every distribution sums to 1.  P(w) is discounted likewise; what
that leaves is the probability of the one class of unknown words.  A history whose counts are all too
large to be discounted counts one event more, which is its mass for unseen words.  A text is scored
as its words and one end, the first word after a start; an unknown history backs off at once.

Scale: the model is never held whole.  Texts become chunks of word numbers (a table in the shared
folder); words, then bigrams, are counted and looked up in tables partitioned by key, to which each
chunk sends its distinct keys once, in compressed blocks.  Partitions grow in number with the tokens.
A history with more than a partition's share of tokens is dealt over several by its next word; there
are at most as many such histories as partitions, so their weights are few.  Every step is written to
the shared folder, and what is used up is deleted.

Defined cases: a null text counts as empty (one token, the end); a null id isn't held out; without
training tokens every word is unknown, with probability 1; repeated rows are scored, and learned from,
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, drop_stored, shards, stored
from .hashing import mix, word_hashes

#: Counts up to this are discounted.
DISCOUNTED = 5
MODULUS, REMAINDER = 10, 0
#: Tokens of one partition of the tables, about.
PARTITION_TOKENS = 1_000_000
UNKNOWN, START, FIRST_ID = 0, 1, 2
#: Stands for the end of a text among word hashes; a real word may only collide with it by chance.
END = np.uint64(0x656E642D6F662D74)


_CODEC = pa.Codec("zstd", 1)


def _pack(x: np.ndarray) -> bytes:
    """An array, compressed by planes of bytes: numbers are small, so most planes are nearly empty."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(b[8:], n * size), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_pairs(pairs: np.ndarray) -> bytes:
    """Rising pairs: the steps of the histories, and the words as they are."""
    steps = _pack(np.diff(pairs >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32))
    return len(steps).to_bytes(8, "little") + steps + _pack(pairs.astype(np.uint32))


def _unpack_pairs(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return (np.cumsum(_unpack(b[8 : 8 + n], np.uint32), dtype=np.uint64) << np.uint64(32)) | _unpack(b[8 + n :], np.uint32)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _emit(schema: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 32):
        yield _batch(schema, rows[i : i + 32])


# --- texts to chunks ---------------------------------------------------------------------------

_CHUNK = "chunk long, doc_ids array<long>, held binary, lengths binary, vocab binary, counts binary, tokens binary, n_train long, d_train long"


def is_held_out(doc_id: int | None, modulus: int = MODULUS, remainder: int = REMAINDER) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def _chunks(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, counts = word_hashes(batch.column(1))
            ends = np.cumsum(counts)
            words = np.insert(words, ends, END)  # one after the words of each text
            lengths = (counts + 1).astype(np.int64)
            held = np.array([is_held_out(i) for i in ids], np.uint8)
            vocab, tokens = np.unique(words, return_inverse=True)
            train = np.repeat(held == 0, lengths)
            seen = np.bincount(tokens[train], minlength=len(vocab))
            yield _batch(_CHUNK, [(chunk, ids, held.tobytes(), lengths.tobytes(), vocab.tobytes(), _pack(seen.astype(np.uint32)), _pack(tokens.astype(np.uint32)), int(train.sum()), int((held == 0).sum()))])
            chunk += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CHUNK)


# --- words -------------------------------------------------------------------------------------

_WORDS = "p int, chunk long, vocab binary, counts binary"
_NUMBERED = "chunk long, p int, ranks binary, totals binary, stats array<long>, classes array<long>"
_CLASSES = 64


def _targets(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _split(target: np.ndarray) -> list[np.ndarray]:
    """Positions by target, in order inside each."""
    order = np.argsort(target, kind="stable")
    return [p for p in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(p)]


def _word_requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab, counts in zip(*(c.to_pylist() for c in batch.columns)):
                vocab, counts = np.frombuffer(vocab, np.uint64), _unpack(counts, np.uint32)
                target = _targets(vocab, parts)
                yield from _emit(_WORDS, [(int(target[at[0]]), chunk, vocab[at].tobytes(), _pack(counts[at])) for at in _split(target)])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each p; rows come sorted by p."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[-1][0] != row[0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _histogram(counts: np.ndarray) -> list[int]:
    """How many have the counts 1, ..., DISCOUNTED + 1; how many there are; their sum."""
    of = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [*of[1 : DISCOUNTED + 2].tolist(), len(counts), int(counts.sum())]


def _number_words():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            p = group[0][0]
            words = [np.frombuffer(r[2], np.uint64) for r in group]
            vocab, at = np.unique(np.concatenate(words), return_inverse=True)
            totals = np.bincount(at, np.concatenate([_unpack(r[3], np.uint32) for r in group]), len(vocab)).astype(np.int64)
            known = totals > 0
            # words are numbered by classes of frequency, so that numbers of frequent words are small
            of = _class(totals)
            order = np.argsort(of, kind="stable")
            size = np.bincount(of, minlength=_CLASSES)
            rank = np.empty(len(vocab), np.int64)
            rank[order] = np.arange(len(vocab)) - np.repeat(np.cumsum(size) - size, size)
            rows = [(None, p, None, None, _histogram(totals[known]), size.tolist())]
            start = 0
            for (_, chunk, _, _), w in zip(group, words):
                mine = at[start : start + len(w)]
                start += len(w)
                rows.append((chunk, p, _pack(rank[mine].astype(np.uint32)), _pack(totals[mine]), None, None))
            yield from _emit(_NUMBERED, rows)

    return run


def _class(totals: np.ndarray) -> np.ndarray:
    """0 for unknown words, 1 and up by powers of two of the count."""
    return np.where(totals > 0, np.frexp(totals.astype(np.float64))[1], 0)


def _class_starts(largest: list[int], parts: int) -> np.ndarray:
    """The first number of each class, frequent classes first, from the most words that a partition has."""
    start, at = np.zeros(_CLASSES, np.int64), FIRST_ID
    for k in range(_CLASSES - 1, 0, -1):
        start[k] = at
        at += largest[k] * parts
    if at >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    return start


_TOKENS = "chunk long, doc_ids array<long>, held binary, lengths binary, ids binary, totals binary, tokens binary"


def _apply_numbers(parts: int, starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, doc_ids, held, lengths, vocab, tokens, replies in zip(*(c.to_pylist() for c in batch.columns)):
                vocab = np.frombuffer(vocab, np.uint64)
                ids, totals = np.zeros(len(vocab), np.uint32), np.zeros(len(vocab), np.int64)
                at = {r["p"]: r for r in replies}
                target = _targets(vocab, parts)
                for mine in _split(target):
                    p = int(target[mine[0]])
                    total = _unpack(at[p]["totals"], np.int64)
                    number = starts[_class(total)] + _unpack(at[p]["ranks"], np.uint32).astype(np.int64) * parts + p
                    ids[mine], totals[mine] = np.where(total > 0, number, UNKNOWN), total
                yield _batch(_TOKENS, [(chunk, doc_ids, held, lengths, _pack(ids), _pack(totals), tokens)])

    return run


# --- the model's numbers -----------------------------------------------------------------------


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts of the counts 0, ..., DISCOUNTED (that of 0 is unused) from n[r - 1] keys with count
    r <= DISCOUNTED + 1; 1 wherever the estimate isn't in (0, 1)."""
    d = np.ones(DISCOUNTED + 1)
    k = DISCOUNTED
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        if n[r - 1] and common < 1:
            value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            if 0 < value < 1:
                d[r] = value
    return d


@dataclass
class Numbers:
    """What every task needs of the model; its size is bounded by the number of partitions."""

    parts: int
    tokens: int  # in training
    distinct: int
    texts: int  # in training
    word_discounts: np.ndarray
    word_extra: int  # 1 where no word's count is discounted
    unknown: float  # probability of the class of unknown words
    discounts: np.ndarray | None = None  # of bigrams
    wide: dict | None = None  # (alpha, extra) of histories that are dealt over partitions

    def word_prob(self, count: np.ndarray) -> np.ndarray:
        """P(w) by the word's count; 0 is the unknown class."""
        p = self.word_discounts[np.minimum(count, DISCOUNTED)] * count if len(count) else count
        p = np.where(count > DISCOUNTED, count, p) / max(self.tokens + self.word_extra, 1)
        return np.where(count > 0, p, self.unknown)

    def salts(self, count: np.ndarray) -> np.ndarray:
        """Over how many partitions a history of this count is dealt."""
        return 1 + count * self.parts // max(self.tokens, 1)

    def target(self, h: np.ndarray, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        salt = mix(w.astype(np.uint64)) % self.salts(count).astype(np.uint64)
        return _targets(mix((h.astype(np.uint64) << np.uint64(24)) + salt), self.parts)


def _word_numbers(stats: list[int], parts: int, texts: int) -> Numbers:
    d = good_turing(stats)
    left = sum((1 - d[r]) * r * stats[r - 1] for r in range(1, DISCOUNTED + 1))
    tokens = stats[-1]
    extra = int(left <= 0)
    return Numbers(parts, tokens, stats[-2], texts, d, extra, (left if left > 0 else 1.0) / max(tokens + extra, 1))


def _weights(seen: np.ndarray, lower: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, extra) of histories: seen[:, r - 1] followers have count r <= DISCOUNTED, the words of
    all followers together have probability `lower`, and the history itself occurs count times."""
    left = (seen * ((1 - d[1:]) * np.arange(1, DISCOUNTED + 1))).sum(1)
    extra = (left <= 0).astype(np.int64)
    return np.where(extra, 1.0, left) / (count + extra) / np.maximum(1 - lower, 1e-300), extra


# --- bigrams -----------------------------------------------------------------------------------

_PAIRS = "p int, kind int, chunk long, pairs binary, follower binary, history binary, more binary, extra binary"
_TABLE = "p int, pairs binary, counts binary, histories binary, occur binary, seen binary, lower binary, stats array<long>, wide binary"


def _history_and_counts(ids, totals, tokens, lengths, texts: int):
    """For each token: the word's number and count, the history's number and count."""
    w, c = ids[tokens], totals[tokens]
    h, ch = np.empty_like(w), np.empty_like(c)
    h[1:], ch[1:] = w[:-1], c[:-1]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    h[first], ch[first] = START, texts
    return w, c, h, ch


def _read_tokens(row) -> tuple:
    chunk, doc_ids, held, lengths, ids, totals, tokens = row
    return chunk, doc_ids, np.frombuffer(held, np.uint8), np.frombuffer(lengths, np.int64), _unpack(ids, np.uint32), _unpack(totals, np.int64), _unpack(tokens, np.uint32)


def _count_requests(numbers: Numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                chunk, _, held, lengths, ids, totals, tokens = _read_tokens(row)
                w, c, h, ch = _history_and_counts(ids, totals, tokens, lengths, numbers.texts)
                train = np.repeat(held == 0, lengths)
                pairs, first, n = np.unique((h[train].astype(np.uint64) << np.uint64(32)) | w[train], return_index=True, return_counts=True)
                if not len(pairs):
                    continue
                c, h, ch, w = c[train][first], h[train][first], ch[train][first], w[train][first]
                target = numbers.target(h, w, ch)
                yield from _emit(_PAIRS, [(int(target[at[0]]), 1, chunk, _pack_pairs(pairs[at]), _pack(c[at]), _pack(ch[at]), _pack(n[at].astype(np.uint32)), None) for at in _split(target)])

    return run


def _count_pairs(numbers: Numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            keys = np.concatenate([_unpack_pairs(r[3]) for r in group])
            pairs, first, at = np.unique(keys, return_index=True, return_inverse=True)
            counts = np.bincount(at, np.concatenate([_unpack(r[6], np.uint32) for r in group]), len(pairs)).astype(np.int64)
            lower = numbers.word_prob(np.concatenate([_unpack(r[4], np.int64) for r in group])[first])
            of = np.concatenate([_unpack(r[5], np.int64) for r in group])[first]
            h = pairs >> np.uint64(32)
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            histories, of = h[start].astype(np.uint32), of[start]
            seen = np.stack([np.add.reduceat((counts == r).astype(np.uint32), start) for r in range(1, DISCOUNTED + 1)], 1)
            mass = np.add.reduceat(lower, start)
            # what partitions of one history must add up
            wide = numbers.salts(of) > 1
            part = np.column_stack([histories[wide].astype(np.float64), of[wide].astype(np.float64), seen[wide].astype(np.float64), mass[wide]])
            yield _batch(_TABLE, [(group[0][0], _pack_pairs(pairs), _pack(counts), _pack(histories), _pack(of), _pack(seen.astype(np.uint32).ravel()), mass.tobytes(), _histogram(counts), part.tobytes())])

    return run


def _score_requests(numbers: Numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                chunk, doc_ids, held, lengths, ids, totals, tokens = _read_tokens(row)
                w, c, h, ch = _history_and_counts(ids, totals, tokens, lengths, numbers.texts)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                base = np.log10((c + 0.1) / (numbers.tokens + 0.1 * (numbers.distinct + 1)))
                sums = [np.bincount(doc, x, len(lengths)) for x in (base, c > 0, np.where(ch > 0, 0.0, np.log10(numbers.word_prob(c))))]
                rows = [(chunk % numbers.parts, 2, chunk, np.array([-1 if i is None else i for i in doc_ids], np.int64).tobytes(), lengths.tobytes(), held.tobytes(), np.concatenate(sums).tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes())]
                # in training every pair is known: only texts that are held out can need P(w)
                out = np.repeat(held > 0, lengths)
                for kind, ask in ((1, np.flatnonzero(~out & (ch > 0))), (3, np.flatnonzero(out & (ch > 0)))):
                    pairs = (h[ask].astype(np.uint64) << np.uint64(32)) | w[ask]
                    order = np.argsort(pairs, kind="stable")
                    pairs, ask = pairs[order], ask[order]
                    for at in _split(numbers.target(h[ask], w[ask], ch[ask])):
                        p = int(numbers.target(h[ask[at[:1]]], w[ask[at[:1]]], ch[ask[at[:1]]])[0])
                        rows.append((p, kind, chunk, _pack_pairs(pairs[at]), _pack(c[ask[at]]) if kind == 3 else None, None, _pack(doc[ask[at]].astype(np.uint32)), None))
                yield from _emit(_PAIRS, rows)

    return run


_PARTIAL = "chunk long, kind int, a binary, b binary, c binary, d binary, e binary"


def _score_pairs(numbers: Numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for batch in batches:
            rows = []
            for p, kind, chunk, pairs, follower, history, more, extra, occur in zip(*(c.to_pylist() for c in batch.columns)):
                if p != at:  # a partition may be asked for histories of which it has no follower
                    at, table = p, _Table(numbers)
                if kind == 0:
                    seen, mass = _unpack(more, np.uint32).reshape(-1, DISCOUNTED), np.frombuffer(extra, np.float64)
                    table = _Table(numbers, _unpack_pairs(pairs), _unpack(follower, np.int64), _unpack(history, np.uint32), _unpack(occur, np.int64), seen, mass)
                elif kind == 2:
                    rows.append((chunk, 0, pairs, follower, history, more, extra))
                else:
                    score = table.score(_unpack_pairs(pairs), _unpack(follower, np.int64) if kind == 3 else None)
                    doc = _unpack(more, np.uint32)
                    who, place = np.unique(doc, return_inverse=True)
                    rows.append((chunk, 1, who.astype(np.uint32).tobytes(), np.bincount(place, score, len(who)).tobytes(), None, None, None))
            yield from _emit(_PARTIAL, rows)

    return run


_NONE = np.zeros(0, np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys the sorted table has, their places); places of the others mean nothing."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[spot] == keys, spot


class _Table:
    """The bigrams of one partition, ready to be looked up."""

    def __init__(self, numbers: Numbers, pairs=_NONE.astype(np.uint64), counts=_NONE, histories=_NONE, occur=_NONE, seen=_NONE.reshape(0, DISCOUNTED), mass=_NONE):
        self.pairs, self.histories, self.numbers = pairs, histories, numbers
        self.alpha, extra = _weights(seen, mass, occur, numbers.discounts)
        for i in np.flatnonzero(numbers.salts(occur) > 1):
            self.alpha[i], extra[i] = numbers.wide[int(histories[i])]
        d = np.where(counts > DISCOUNTED, 1.0, numbers.discounts[np.minimum(counts, DISCOUNTED)])
        total = (occur + extra)[np.searchsorted(histories, (pairs >> np.uint64(32)).astype(np.uint32))]
        self.known = np.log10(d * counts / total)

    def score(self, key: np.ndarray, c: np.ndarray | None) -> np.ndarray:
        """log10 P(w | h) of pairs whose history occurs in training; c: the words' counts."""
        hit, spot = _find(self.pairs, key)
        score = np.zeros(len(key))
        score[hit] = self.known[spot[hit]]
        if len(miss := np.flatnonzero(~hit)):
            alpha = self._alpha((key[miss] >> np.uint64(32)).astype(np.uint32))
            score[miss] = np.log10(np.maximum(alpha * self.numbers.word_prob(c[miss]), 1e-300))
        return score

    def _alpha(self, h: np.ndarray) -> np.ndarray:
        hit, spot = _find(self.histories, h)
        alpha = np.zeros(len(h))
        alpha[hit] = self.alpha[spot[hit]]
        # a history dealt over partitions may have none of its followers in this one
        for i in np.flatnonzero(~hit):
            alpha[i] = self.numbers.wide[int(h[i])][0]
        return alpha


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(numbers: Numbers):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (info,) = [r for r in rows if r["kind"] == 0]
        ids, lengths, held = np.frombuffer(info["a"], np.int64), np.frombuffer(info["b"], np.int64), np.frombuffer(info["c"], np.uint8)
        base, known, score = np.frombuffer(info["d"], np.float64).reshape(3, -1).copy()
        for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["a"]):
            score[np.frombuffer(r["a"], np.uint32)] += np.frombuffer(r["b"], np.float64)
        cols = [pa.array(ids, pa.int64(), mask=np.frombuffer(info["e"], np.uint8) > 0), pa.array(held > 0), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), numbers.tokens)), pa.array(base), pa.array(score)]
        return pa.table(cols, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shards(rows.sparkSession), "p").sortWithinPartitions("p", *order)


@dataclass
class KatzModel:
    """Chunks of the texts, the numbers, and the bigram table partitioned by history."""

    tokens: DataFrame
    numbers: Numbers
    table: DataFrame


def fit(docs: DataFrame) -> KatzModel:
    """Learn from the documents that are not held out; the chunks hold all, for score()."""
    spark = docs.sparkSession
    chunks = stored(_chunks(docs), "chunks")
    total, texts = chunks.agg(F.sum("n_train"), F.sum("d_train")).first()
    parts = max(4 * shards(spark), (total or 0) // PARTITION_TOKENS)
    words = chunks.select("chunk", "vocab", "counts").mapInArrow(_word_requests(parts), _WORDS)
    numbered = stored(_dealt(words).mapInArrow(_number_words(), _NUMBERED), "words")
    stats = _sum_stats(numbered)
    numbers = _word_numbers(stats, parts, texts or 0)
    replies = numbered.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("p", "ranks", "totals")).alias("replies"))
    joined = chunks.select("chunk", "doc_ids", "held", "lengths", "vocab", "tokens").join(replies, "chunk")
    largest = dict(map(tuple, numbered.filter("classes is not null").select(F.posexplode("classes")).groupBy("pos").agg(F.max("col")).collect()))
    starts = _class_starts([largest.get(k, 0) for k in range(_CLASSES)], parts)
    tokens = stored(joined.mapInArrow(_apply_numbers(parts, starts), _TOKENS), "tokens")
    drop_stored(chunks, numbered)
    pairs = tokens.mapInArrow(_count_requests(numbers), _PAIRS)
    table = stored(_dealt(pairs).mapInArrow(_count_pairs(numbers), _TABLE), "pairs")
    drop_stored()
    numbers.discounts = good_turing(_sum_stats(table))
    # histories dealt over several partitions: fewer than there are partitions, a few numbers each
    sums: dict[int, np.ndarray] = {}
    for row in table.filter(F.octet_length("wide") > 0).select("wide").toLocalIterator():
        for h, *x in np.frombuffer(row[0], np.float64).reshape(-1, DISCOUNTED + 3):
            x = np.array(x)
            sums[int(h)] = x if int(h) not in sums else np.array([x[0], *(sums[int(h)][1:] + x[1:])])
    numbers.wide = {}
    for h, x in sums.items():
        alpha, extra = _weights(x[None, 1 : DISCOUNTED + 1], x[None, -1][0], x[None, 0], numbers.discounts)
        numbers.wide[h] = (float(alpha[0]), int(extra[0]))
    return KatzModel(tokens, numbers, table)


def _sum_stats(rows: DataFrame) -> list[int]:
    sums = rows.filter("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).collect()
    found = dict(map(tuple, sums))
    return [int(found.get(i, 0)) for i in range(DISCOUNTED + 3)]


def score(model: KatzModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the model's chunks."""
    table = model.table.select("p", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "pairs", F.col("counts").alias("follower"), F.col("histories").alias("history"), F.col("seen").alias("more"), F.col("lower").alias("extra"), "occur")
    asked = model.tokens.mapInArrow(_score_requests(model.numbers), _PAIRS)
    parts = _dealt(table.unionByName(asked, allowMissingColumns=True), "kind").mapInArrow(_score_pairs(model.numbers), _PARTIAL)
    return parts.groupBy("chunk").applyInArrow(_finish(model.numbers), _SCORED)


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(fit(documents(spark, sf_dir)))
