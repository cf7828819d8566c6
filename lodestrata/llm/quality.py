"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams (2 to 4 bytes, 2**18 places) and of words that stand
several times in a row.  Each is scaled by the log ratio of its smoothed class counts, rows are
brought to a length that tends to 1 (short texts stay near the bias), a linear hinge-loss model is fit
by dual coordinate descent, and a sigmoid through out-of-fold margins turns margins into scores.
Only texts go into features; labels, ids, languages and sources don't.

Scale: the fit takes at most MAX_TRAIN labelled documents (those with the smallest hashes of their
ids, so a sample that does not depend on order), gathered as all their feature places, packed in two
bytes a place and at most 32 KB a document (256 MB in all) however long its text.  It runs in one task
on an executor, which sends the driver the model alone.  Scoring is one map over whole texts, without
a shuffle, with a model of fixed size.

Defined cases: a null text counts as empty; an empty text has the score of the bias alone; a document
with null id is scored and counts as not held out; labels that are null or not 0 or 1 teach nothing,
and repeated labels of a document teach by their smallest value; without labels of both classes every
score is the share of label 1 (0.5 without any); an empty table gives no rows; other columns pass
through filter_quality unchanged and are otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents
from .hashing import text_buffer, word_hashes

PLACES = 1 << 18
SIZES = (2, 3, 4)
#: Most labelled documents that the fit takes, with all places of each.
MAX_TRAIN = 8_000
THRESHOLD = 0.7
_PIECE = 1 << 20
#: Added to a row's squared length before it is divided by.
SHRINK = 150.0
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def _repeats(body: np.ndarray) -> list[tuple[int, int]]:
    """(n, longest run) for n = 1, 2, 3: how many words in a row equal the word n before them."""
    words, _ = word_hashes(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(body)], np.int64)), pa.py_buffer(np.ascontiguousarray(body))))
    out = []
    for n in (1, 2, 3):
        other = np.flatnonzero(words[n:] != words[:-n]) if len(words) > n else np.zeros(0, np.int64)
        edges = np.concatenate([[-1], other, [max(len(words) - n, 0)]])
        out.append((n, int(np.diff(edges).max()) - 1))
    return out


class Places:
    """The distinct feature places of texts."""

    def __init__(self) -> None:
        self.seen = np.zeros(PLACES, bool)

    def of(self, body: np.ndarray) -> np.ndarray:
        for a in range(0, max(len(body), 1), _PIECE):
            part = body[a : a + _PIECE + max(SIZES) - 1].astype(np.uint32)
            gram = part
            for size in range(2, max(SIZES) + 1):
                gram = (gram[:-1] << np.uint32(8)) | part[size - 1 :]
                if size in _MULTIPLIERS and len(gram):
                    self.seen[(gram * np.uint32(_MULTIPLIERS[size])) >> np.uint32(14)] = True
        for period, longest in _repeats(body):
            self.seen[[(PLACES >> 1) + 64 * period + k for k in range(min(longest, 60)) if not k & (k - 1)]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def _pack_places(found: np.ndarray) -> bytes:
    """Rising places without loss: how many lie in each 2**16, then their low 16 bits; or a bit for each
    of all PLACES where that is shorter."""
    blocks = PLACES >> 16
    if 2 * (blocks + len(found)) >= PLACES // 8:
        bits = np.zeros(PLACES, np.uint8)
        bits[found] = 1
        return np.packbits(bits).tobytes()
    return np.concatenate([np.bincount(found >> 16, minlength=blocks), found & 0xFFFF]).astype(np.uint16).tobytes()


def _unpack_places(data: bytes | pa.Buffer) -> np.ndarray:
    packed = np.frombuffer(data, np.uint16)
    if packed.nbytes == PLACES // 8:
        return np.flatnonzero(np.unpackbits(packed.view(np.uint8)))
    blocks = PLACES >> 16
    return np.repeat(np.arange(blocks) << 16, packed[:blocks]) + packed[blocks:]


class _Rows(Sequence):
    """Chosen rows of others, each made when it is read."""

    def __init__(self, rows: Sequence, chosen: Sequence[int], read: Callable = lambda row: row):
        self.rows, self.chosen, self.read = rows, chosen, read

    def __len__(self) -> int:
        return len(self.chosen)

    def __getitem__(self, i):
        return self.read(self.rows[self.chosen[i]])


def _dual_coordinate_descent(places: Sequence[np.ndarray], scale: np.ndarray, lengths: np.ndarray, y: np.ndarray, c: float, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2/2 + c sum hinge(y_i w.x_i), one dual variable at a time.

    Row i has scale[places[i]] / lengths[i] at its places, and 1 for the bias; it is made when needed,
    so memory goes with the places alone.
    """
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(places))
    size = [float((scale[p] ** 2).sum()) / n**2 + 1.0 for p, n in zip(places, lengths)]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(places)):
            place = places[i]
            x = scale[place] / lengths[i]
            gradient = y[i] * (w[place] @ x + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / size[i], 0.0), c)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[place] += step * y[i] * x
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = p - target
        h = p * (1 - p) + 1e-9
        ga, gb = (g * margin).sum(), g.sum()
        haa, hab, hbb = (h * margin**2).sum() + 1e-6, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)


class Model:
    """Weights of the places, bias, and the sigmoid's two numbers."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, a: float, b: float):
        # an indicator's x is its ratio over the row's length, so two sums give the margin
        self._set((weights[:-1] * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(weights[-1]), a, b)

    def _set(self, product: np.ndarray, square: np.ndarray, bias: float, a: float, b: float) -> None:
        self.product, self.square, self.bias, self.a, self.b = product, square, bias, a, b

    @classmethod
    def of(cls, product: np.ndarray, square: np.ndarray, bias: float, a: float, b: float) -> Model:
        """A model from its own numbers, as a fit on an executor sends them."""
        model = cls.__new__(cls)
        model._set(product, square, bias, a, b)
        return model

    def score(self, place: np.ndarray) -> float:
        length = (float(self.square[place].sum(dtype=np.float64)) + SHRINK) ** 0.5
        margin = self.bias + float(self.product[place].sum(dtype=np.float64)) / length
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -40, 40))))


def train(places: Sequence[np.ndarray], labels: np.ndarray, c: float = 5.0, folds: int = 3) -> Model:
    """The model of feature places and labels 0 or 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = 0.5 if not len(y) else min(max((labels > 0).mean(), 1e-6), 1 - 1e-6)
        return Model(np.zeros(PLACES + 1), np.zeros(PLACES), 0.0, float(np.log(share / (1 - share))))

    def fit(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos, neg = np.ones(PLACES), np.ones(PLACES)
        for i in chosen:
            (pos if y[i] > 0 else neg)[places[i]] += 1
        ratios = np.log((pos / pos.sum()) / (neg / neg.sum()))
        mine = _Rows(places, chosen)
        lengths = np.array([np.sqrt((ratios[p] ** 2).sum() + SHRINK) for p in mine])
        return _dual_coordinate_descent(mine, ratios, lengths, y[chosen], c), ratios

    everything = np.arange(len(y))
    held = np.full(len(y), np.nan)
    for k in range(folds):
        chosen = everything[everything % folds != k]
        if abs(y[chosen].sum()) == len(chosen):
            continue
        weights, ratios = fit(chosen)
        partial = Model(weights, ratios, 1.0, 0.0)
        for i in everything[everything % folds == k]:
            p = min(max(partial.score(places[i]), 1e-15), 1 - 1e-15)
            held[i] = np.log(p / (1 - p))
    weights, ratios = fit(everything)
    known = ~np.isnan(held)
    a, b = _sigmoid_fit(held[known], y[known]) if known.any() and abs(y[known].sum()) < known.sum() else (1.0, 0.0)
    return Model(weights, ratios, max(a, 1e-3), b)


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Places()
    for batch in batches:
        values, offsets = text_buffer(batch.column(1))
        out = [_pack_places(finder.of(values[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "places"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model learned from labels (doc_id, quality) of documents that are not held out."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has a proven bound, MAX_TRAIN rows of two numbers
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").mapInArrow(_place_batches, "doc_id long, label int, places binary")
    found = rows.repartition(1).mapInArrow(_fit_batches, _MODEL).first()
    if found is None:
        return train([], np.zeros(0))
    return Model.of(np.frombuffer(found["product"], np.float32), np.frombuffer(found["square"], np.float32), found["bias"], found["a"], found["b"])


_MODEL = "product binary, square binary, bias double, a double, b double"


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, one row of fixed size, of all rows of the sample; no row without rows.

    One task, whose memory the sample's bound bounds: 32 KB a row at most.  Rows come in any order, so
    the fit goes by id and label; a lost executor means the same fit again.
    """
    rows: list[tuple[int, int, bytes]] = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns))
    if rows:
        rows.sort()
        packed = [p for _, _, p in rows]
        model = train(_Rows(packed, range(len(packed)), _unpack_places), np.array([x for _, x, _ in rows]))
        cells = (model.product.tobytes(), model.square.tobytes(), model.bias, model.a, model.b)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.binary(), pa.binary(), *[pa.float64()] * 3))], [x.split()[0] for x in _MODEL.split(", ")])


def score_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns and rows of docs, and the score of each whole text in the column `name`."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, fitted = Places(), sent.value
        for batch in batches:
            values, offsets = text_buffer(batch.column(at).cast(pa.large_string()))
            scores = [fitted.score(finder.of(values[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*fields, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns that they had."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, fit_quality(docs, labels), name).filter(F.col(name) >= threshold).drop(name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
