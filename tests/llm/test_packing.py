from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import optimal_boundaries, pack, word_lengths


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(counts, k):
    histogram = sorted(counts.items())
    ends, waste = optimal_boundaries([x for x, _ in histogram], [n for _, n in histogram], k)
    lengths = [x for x, _ in histogram]
    best = min(padding(histogram, [*c, lengths[-1]]) for size in range(min(k, len(lengths))) for c in combinations(lengths[:-1], size))
    assert len(ends) <= k and ends == sorted(set(ends)) and waste == padding(histogram, ends) == best


def test_no_lengths():
    assert optimal_boundaries([], [], 4) == ([], 0)


def test_batches(spark):
    lengths = [(i, (i * 37) % 90 + (20_000 if i == 7 else 0)) for i in range(500)] + [(70_000, 5), (200_000, None), (None, 5)]
    rows = pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), buckets=4, token_budget=256).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in lengths)
    by = {}
    for r in rows:
        assert r["padding"] == r["bucket_width"] - r["n_tokens"] >= 0
        by.setdefault(r["bucket"], []).append(r)
    assert len(by) <= 4
    for group in by.values():
        room = max(1, 256 // group[0]["bucket_width"])
        order = sorted(group, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert [(r["batch"], r["slot"]) for r in order] == [(i // room, i % room) for i in range(len(order))]
    histogram = sorted(Counter(max(n or 0, 1) for _, n in lengths).items())
    assert by[max(by)][0]["bucket_width"] >= 20_000
    small = [h for h in histogram if h[0] < 20_000]
    ends = sorted({g[0]["bucket_width"] for g in by.values()})
    best, _ = optimal_boundaries([x for x, _ in small], [n for _, n in small], 3)
    assert ends[:3] == best


def test_repeated_ids_empty_table_and_words(spark):
    rows = pack(spark.createDataFrame([(1, 3)] * 5, "doc_id long, n_tokens long"), token_budget=6).collect()
    assert sorted((r["batch"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).isEmpty()
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, " a\tb c\n", 3), (4, "w " * 50_000, 4)], "doc_id long, text string, n_tokens int")
    assert {r["doc_id"]: r["n_tokens"] for r in word_lengths(docs).collect()} == {1: 0, 2: 0, 3: 2, 4: 50_000}


def test_sparse_ids_clashing_names_and_real_widths(spark):
    from pyspark.sql import functions as F

    n = 30_000
    lengths = spark.range(n).select(F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.xxhash64("id")).alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) + F.lit(16_000)).alias("n_tokens"), F.lit(1).alias("bucket"), F.lit("x").alias("_len"), F.lit(2).alias("slot"))
    rows = pack(lengths, buckets=5, token_budget=200_000).collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        assert r["padding"] == r["bucket_width"] - r["n_tokens"] >= 0
        by.setdefault(r["bucket"], []).append(r)
    for group in by.values():
        assert group[0]["bucket_width"] == max(r["n_tokens"] for r in group)  # no width that no document has
        room = 200_000 // group[0]["bucket_width"]
        assert sorted((r["batch"], r["slot"]) for r in group) == [(i // room, i % room) for i in range(len(group))]
        order = sorted(group, key=lambda r: (r["batch"], r["slot"]))
        assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in order), key=lambda i: (i is not None, i or 0))
