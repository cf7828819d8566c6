"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within epsilon = sqrt(2 - 2t) of each other.  They are
rotated so that a few leading coordinates carry most of the spread, and sorted by label, then by the
cells of side epsilon in those coordinates: the epsilon grid order.  The order is cut into blocks.
Blocks whose boxes are farther apart than epsilon in some coordinate are never paired, and a pair of
blocks is joined by recursion: halves of the two sequences that are provably distant are skipped, and
what remains is compared in double precision.

Scale: equal vectors are one class first, so copies count but are never paired.  A block has at most
BLOCK classes; blocks that follow each other in the order form groups of bounded bytes, and a pair of
groups with near blocks is one task's work, so a dense region is many tasks'.  Pairs of blocks meet by
an equality join on the cells that their boxes cover; a block is sent once to each pair of groups that
needs it.  Links leave a task as counts for each vector and as a spanning forest, never as all pairs.  The rotation is fitted on at
most SAMPLE vectors; it decides speed only, since distance in any coordinates never exceeds distance.

Defined cases: vectors that are null, empty or zero, hold null or non-finite components, or have a
null id or label, link with nothing (n_links 0, their own component, kept); so do vectors of different
lengths; repeated rows are vectors of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shards, stored
from .components import connected_components

THRESHOLD = 0.98
BLOCK = 1024
LEAF = 64
SAMPLE = 4_096
#: Bytes of the vectors of one group of blocks, about; a task holds two groups.
GROUP_BYTES = 16 << 20
#: Cosines that lie this close to the threshold are computed again with more digits.
CLOSE = 1e-12
#: Leading coordinates: of the grid order and boxes, and of those the ones by which blocks meet.
LEADING, MEETING = 8, 3


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, and for valid vectors the class that equal vectors of a label form."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    big = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0)
    return v.withColumn("valid", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))


def _rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the leading directions of a bounded sample."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    found = {}
    for n in {len(r) for r in rows}:
        x = np.array([r for r in rows if len(r) == n])
        x = _unit(x)
        _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(n, n))
        found[n] = axes[:, ::-1][:, : min(n, LEADING)]
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite and above zero
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_PLACED = "rep long, copies long, label long, dim int, coords array<double>, unit binary"


def _place(classes: DataFrame, rotations: dict[int, np.ndarray]) -> DataFrame:
    """Unit vectors with their leading coordinates."""
    sent = classes.sparkSession.sparkContext.broadcast(rotations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords, units, dims = [], [], []
            for row in batch.column(3).to_pylist():
                unit = _unit(np.array([row], np.float64))[0]
                axes = sent.value.get(len(unit))
                at = unit[:LEADING] if axes is None else unit @ axes
                coords.append([*at.tolist(), *[0.0] * (LEADING - len(at))])
                units.append(unit.tobytes())
                dims.append(len(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(coords, pa.list_(pa.float64())), pa.array(units, pa.binary())], [x.split()[0] for x in _PLACED.split(", ")])

    return classes.select("rep", "copies", "label", "embedding").mapInArrow(run, _PLACED)


_BLOCKS = "block string, team string, label long, dim int, lo array<double>, hi array<double>, reps binary, copies binary, coords binary, units binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]


def _cut_blocks(most: int, group_bytes: int):
    """Runs of at most `most` rows of one label and length, in grid order, as one row each; `team` names
    the group of blocks that a block belongs to."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(6)))

        for (label, dim), run in itertools.groupby(rows(), key=lambda r: (r[2], r[3])):
            size = max(1, group_bytes // (most * 8 * max(dim, 1)))
            for k in itertools.count():
                if not (some := list(itertools.islice(run, most))):
                    break
                reps = np.array([r[0] for r in some], np.int64)
                coords = np.array([r[4] for r in some])
                block = f"{label}:{dim}:{reps[0]}"
                if k % size == 0:
                    team = block
                cells = [[block], [team], [label], [dim], [coords.min(0).tolist()], [coords.max(0).tolist()], [reps.tobytes()], [np.array([r[1] for r in some], np.int64).tobytes()], [coords.tobytes()], [b"".join(r[5] for r in some)]]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], _BLOCK_NAMES)

    return cut


def grid_blocks(placed: DataFrame, epsilon: float, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The blocks of the epsilon grid order."""
    cells = [F.floor(F.col("coords")[i] / epsilon).alias(f"c{i}") for i in range(LEADING)]
    order = ["label", "dim", *[f"c{i}" for i in range(LEADING)], "rep"]
    sorted_rows = placed.select("*", *cells).repartitionByRange(shards(placed.sparkSession), *order).sortWithinPartitions(*order)
    return sorted_rows.select("rep", "copies", "label", "dim", "coords", "unit").mapInArrow(_cut_blocks(block, group_bytes), _BLOCKS)


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) with a <= b of the blocks whose boxes come within epsilon in every coordinate."""
    boxes = blocks.select("block", "label", "dim", "lo", "hi")

    def covered(reach: float) -> DataFrame:
        out = boxes
        for i in range(MEETING):
            out = out.withColumn(f"m{i}", F.explode(F.sequence(F.floor((F.col("lo")[i] - reach) / epsilon), F.floor((F.col("hi")[i] + reach) / epsilon))))
        return out

    keys = ["label", "dim", *[f"m{i}" for i in range(MEETING)]]
    left = covered(0.0).select(*keys, F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    right = covered(epsilon).select(*keys, F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    near = F.col("a") <= F.col("b")
    for i in range(LEADING):
        near = near & (F.col("alo")[i] - epsilon <= F.col("bhi")[i]) & (F.col("blo")[i] - epsilon <= F.col("ahi")[i])
    return left.join(right, keys).filter(near).select("a", "b").distinct()


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class _Side:
    def __init__(self, reps: bytes, copies: bytes, coords: bytes, units: bytes, dim: int):
        self.reps, self.copies = np.frombuffer(reps, np.int64), np.frombuffer(copies, np.int64)
        self.coords, self.units = np.frombuffer(coords).reshape(-1, LEADING), np.frombuffer(units).reshape(-1, dim)
        self.links = np.zeros(len(self.reps), np.int64)


def _join_sequences(a: _Side, b: _Side, i: int, j: int, k: int, m: int, epsilon: float, threshold: float, same: bool, forest: _Forest, edges: list) -> None:
    """Join a[i:j] with b[k:m], skipping what the boxes of the two intervals prove distant."""
    if same and k < i:  # the mirror image
        return
    x, y = a.coords[i:j], b.coords[k:m]
    if (x.min(0) - y.max(0) > epsilon).any() or (y.min(0) - x.max(0) > epsilon).any():
        return
    if j - i > LEAF or m - k > LEAF:
        first = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > LEAF else [(i, j)]
        second = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > LEAF else [(k, m)]
        for p, q in first:
            for r, s in second:
                _join_sequences(a, b, p, q, r, s, epsilon, threshold, same, forest, edges)
        return
    cosine = a.units[i:j] @ b.units[k:m].T
    near = cosine >= threshold
    for p, q in zip(*np.nonzero(np.abs(cosine - threshold) < CLOSE)):
        u, v = a.units[i + p].astype(np.longdouble), b.units[k + q].astype(np.longdouble)
        near[p, q] = (u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum()) >= threshold
    if same and i == k:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    a.links[i:j] += near @ b.copies[k:m]
    if not (same and i == k):
        b.links[k:m] += near.T @ a.copies[i:j]
    for p, q in zip(*np.nonzero(near)):
        u, v = int(a.reps[i + p]), int(b.reps[k + q])
        if forest.join(u, v):
            edges.append((u, v))


_FOUND = "rep long, n long, other long"


def _join_groups(threshold: float, epsilon: float):
    """Links of all pairs of blocks of two groups (side 0 and 1), or inside one (side 0 alone)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("side", "block", "dim", "reps", "copies", "coords", "units"))), key=lambda r: r[:2])
        sides = [[_Side(*r[3:], r[2]) for r in rows if r[0] == side] for side in (0, 1)]
        edges: list = []
        forest = _Forest()
        pairs = itertools.product(*sides) if sides[1] else itertools.combinations_with_replacement(sides[0], 2)
        for a, b in pairs:
            _join_sequences(a, b, 0, len(a.reps), 0, len(b.reps), epsilon, threshold, a is b, forest, edges)
        rep, n, other = [u for u, _ in edges], [0] * len(edges), [v for _, v in edges]
        for s in itertools.chain(*sides):
            hit = s.links > 0
            rep += s.reps[hit].tolist()
            n += s.links[hit].tolist()
            other += [None] * int(hit.sum())
        return pa.table([pa.array(c, pa.int64()) for c in (rep, n, other)], names=["rep", "n", "other"])

    return run


def group_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(one, two, side, block): the blocks that each pair of groups needs, each of them once."""
    team = blocks.select("block", "team")
    pairs = block_pairs(blocks, epsilon).join(team.toDF("a", "ta"), "a").join(team.toDF("b", "tb"), "b")
    one, two = F.least("ta", "tb"), F.greatest("ta", "tb")
    needs = F.array(*[F.struct((F.col(t) != one).cast("int").alias("side"), F.col(b).alias("block")) for b, t in (("a", "ta"), ("b", "tb"))])
    return pairs.select(one.alias("one"), two.alias("two"), F.explode(needs).alias("need")).select("one", "two", "need.side", "need.block").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    epsilon = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    rows = _classes(vectors)
    key = ["label", "_h", "_g"]
    hashed = rows.filter("valid").withColumn("_h", F.xxhash64("embedding")).withColumn("_g", F.xxhash64(F.lit(7), F.size("embedding"), "embedding"))
    classes = stored(hashed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").cast("long").alias("copies"), F.first("embedding").alias("embedding")), "classes")
    blocks = stored(grid_blocks(_place(classes, _rotations(classes)), epsilon, block, group_bytes), "blocks")
    work = group_pairs(blocks, epsilon).join(blocks.select("block", "dim", "reps", "copies", "coords", "units"), "block")
    found = stored(work.groupBy("one", "two").applyInArrow(_join_groups(threshold, epsilon), _FOUND), "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    verdict = classes.select(*key, "rep", "copies").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    verdict = verdict.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    valid = hashed.select("vec_id", *key).join(verdict, key).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return valid.unionByName(alone)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
parts AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON u = vec_id
"""
