"""Packing into optimal length buckets.

The histogram of all lengths is the input of a dynamic program that chooses bucket boundaries with
the least padding: cost(i, j] pads every length of (i, j] to the length at j.  Its minimum over i is
a minimum of lines in the length at j, with slopes that fall, so a lower envelope finds each layer in
linear time.  In each bucket the documents, in id order, fill batches of token_budget // width rows.

Scale: one scan counts by built-in functions, and writes 20 bytes a document; the histogram has a
proven bound (lengths up to 2**14 are exact; above that those that agree in 14 significant bits are a
class, which ends at its longest document, so there are under 8,192 for each doubling).  Places in a
bucket come from one numbering of all rows over written ranges of (bucket, id, row), whatever the ids
are like, so no task holds a bucket, nor all rows of one id.

Defined cases: a null text counts as empty, a document without tokens takes one padded place; longer
documents than the budget are a batch of their own, never cut; repeated ids are ranked in any order
among themselves; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import numbered
from .common import documents, stored

BUCKETS = 16
TOKEN_BUDGET = 16_384
_EXACT_BITS = 14


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], k: int) -> tuple[list[int], int]:
    """(upper bounds of at most k buckets, padding) for distinct rising lengths; least padding, and
    of equal choices the fewest buckets."""
    n = len(lengths)
    if not n:
        return [], 0
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    tokens = sum(x * c for x, c in zip(lengths, counts))
    # area[j]: padded tokens of the first j lengths; padding is area less tokens
    area = [None] + [lengths[j - 1] * total[j] for j in range(1, n + 1)]
    back: list[list[int]] = [[0] * (n + 1)]
    best_area, best_layer = area[n], 0
    for layer in range(1, min(k, n)):
        new: list = [None] * (n + 1)
        come = [0] * (n + 1)
        lines: deque[tuple[int, int, int]] = deque()  # slope, intercept, i
        for j in range(layer + 1, n + 1):
            i = j - 1
            slope, start = -total[i], area[i]
            while len(lines) > 1:
                (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                if (start - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                    lines.pop()
                else:
                    break
            lines.append((slope, start, i))
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            m, b, come[j] = lines[0]
            new[j] = m * x + b + x * total[j]
        back.append(come)
        area = new
        if area[n] < best_area:
            best_area, best_layer = area[n], layer
    ends, j = [], n
    for layer in range(best_layer, -1, -1):
        ends.append(lengths[j - 1])
        j = back[layer][j]
    return ends[::-1], best_area - tokens


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (runs outside ASCII white space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))


def pack(lengths: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens -> doc_id, n_tokens, bucket, bucket_width, batch, slot, padding.

    bucket counts from 0; batch numbers the batches of a bucket, slot the rows of a batch.
    """
    spark = lengths.sparkSession
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "lengths").withColumn("_len", F.greatest("n_tokens", F.lit(1)).cast("long"))
    step = f"shiftleft(1L, greatest(0, length(bin(_len)) - {_EXACT_BITS}))"
    classes = rows.groupBy(F.expr(f"(_len + {step} - 1) div {step} * {step}")).agg(F.max("_len"), F.count("*"))
    histogram = sorted((longest, n) for _, longest, n in classes.collect())
    ends, _ = optimal_boundaries([w for w, _ in histogram], [n for _, n in histogram], buckets)
    if not ends:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, bucket_width long, batch long, slot int, padding long")
    before = [sum(n for w, n in histogram if w <= e) for e in (0, *ends)]  # rows of the buckets below each
    bounds, offsets = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (ends, before))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda e: e < F.col("_len")))).withColumn("bucket_width", F.element_at(bounds, F.col("bucket") + 1))
    placed = numbered(rows, "_n", [F.col("bucket").asc(), F.col("doc_id").asc_nulls_first(), F.col("_row").asc()])
    placed = placed.withColumn("_at", F.col("_n") - 1 - F.element_at(offsets, F.col("bucket") + 1)).withColumn("_rows", F.expr(f"greatest(1L, {token_budget} div bucket_width)"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_width",
        F.expr("_at div _rows").alias("batch"), F.expr("cast(_at % _rows as int)").alias("slot"), (F.col("bucket_width") - F.col("n_tokens")).alias("padding"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(documents(spark, sf_dir)))


def _oracle(buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> str:
    """SQL of op1_packing: the dynamic program as one join a layer, its path kept in a list.  Of equal
    sums the latest boundary counts, and the fewest buckets, as in optimal_boundaries()."""
    layers = ["l0 AS (SELECT j, len, total, CAST(len * total AS HUGEINT) AS area, CAST([] AS BIGINT[]) AS ends FROM h)"]
    for k in range(1, buckets):
        layers.append(
            f"""l{k} AS (SELECT j, len, total, area, ends FROM (
    SELECT b.j, b.len, b.total, a.area + b.len * (b.total - a.total) AS area, list_append(a.ends, a.len) AS ends,
           row_number() OVER (PARTITION BY b.j ORDER BY a.area + b.len * (b.total - a.total), a.j DESC) AS r
    FROM l{k - 1} a JOIN h b ON a.j < b.j) WHERE r = 1)"""
        )
    final = " UNION ALL ".join(f"SELECT {k} AS k, area, list_append(ends, len) AS ends FROM l{k} WHERE j = (SELECT max(j) FROM h)" for k in range(buckets))
    return rf"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
w AS (SELECT *, CAST(ceil(greatest(n_tokens, 1) / step) * step AS BIGINT) AS width
      FROM (SELECT *, pow(2, greatest(0, floor(log2(greatest(n_tokens, 1))) - {_EXACT_BITS - 1})) AS step FROM d)),
h AS (SELECT row_number() OVER (ORDER BY len) AS j, len, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS total
      FROM (SELECT max(greatest(n_tokens, 1)) AS len, count(*) AS n FROM w GROUP BY width)),
{", ".join(layers)},
best AS (SELECT ends FROM ({final}) ORDER BY area, k LIMIT 1),
b AS (SELECT doc_id, n_tokens, CAST(len(list_filter(ends, lambda e: e < greatest(n_tokens, 1))) AS INTEGER) AS bucket, ends FROM w, best),
r AS (SELECT doc_id, n_tokens, bucket, ends[bucket + 1] AS bucket_width, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS place FROM b)
SELECT doc_id, n_tokens, bucket, bucket_width, place // greatest(1, {token_budget} // bucket_width) AS batch,
       CAST(place % greatest(1, {token_budget} // bucket_width) AS INTEGER) AS slot, bucket_width - n_tokens AS padding FROM r
"""


ORACLE = _oracle()
