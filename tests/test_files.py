"""Pruning, level policy and compaction on derived file tables."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import compaction, policy, pruning
from lodestrata.operators import versions as V
from lodestrata.plans import queries as Q

LOG = "key string, seq bigint, op tinyint, value string"


def test_island_is_a_transitive_closure(spark):
    # A meets B, B meets C, A and C don't meet
    files = spark.createDataFrame([(1, "a", "c"), (2, "b", "f"), (3, "e", "h"), (4, "k", "m"), (5, "m", "n")], "file long, lo string, hi string")
    assert {r["file"] for r in policy.closure(files, 1).collect()} == {1, 2, 3}
    assert {r["file"] for r in policy.closure(files, 5).collect()} == {4, 5}
    assert {r["file"] for r in policy.overlapping_files(files.filter("file = 2"), files).collect()} == {1, 2, 3}


def test_islands_are_the_components_of_overlap(spark):
    rnd = random.Random(2)
    ranges = [(i, *sorted((rnd.randrange(300), rnd.randrange(300)))) for i in range(25)]
    ranges = [(i, lo, min(hi, lo + 15)) for i, lo, hi in ranges]
    files = spark.createDataFrame([(i, f"{lo:03d}", f"{hi:03d}") for i, lo, hi in ranges], "file long, lo string, hi string")
    got = {}
    for r in policy.islands(files).collect():
        got.setdefault(r["island"], set()).add(r["file"])
    part = {i: {i} for i, _, _ in ranges}
    for i, a, b in ranges:
        for j, c, d in ranges:
            if a <= d and c <= b:
                part[i] |= part[j]
                for k in part[i]:
                    part[k] = part[i]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, {id(v): v for v in part.values()}.values()))


def test_scores(spark):
    files = spark.createDataFrame([(i, 0, "a", "b", 10) for i in range(6)] + [(9, 1, "a", "b", 5 << 20), (10, 6, "a", "b", 1 << 40)], "file long, level int, lo string, hi string, n_bytes long")
    assert {r["level"]: r["score"] for r in policy.level_scores(files).collect()} == {0: 1.5, 1: 0.5}
    assert policy.level_capacity(3) == 1000 << 20


def test_a_delete_stays_while_something_older_may_be_left(spark):
    merged = spark.createDataFrame([("a", 5, 0, None), ("b", 6, 0, None), ("c", 7, 1, "v"), ("d", 8, 0, None)], LOG)
    rest = spark.createDataFrame([("a", "a", 1), ("b", "b", 9)], "lo string, hi string, seq_lo bigint")
    kept = {r["key"] for r in compaction.drop_tombstones(merged, rest).collect()}
    assert kept == {"a", "c"}  # b's other file holds only newer versions, d has none
    assert {r["key"] for r in compaction.drop_tombstones(merged, rest, settled=6).collect()} == {"a", "c", "d"}


def test_compaction_preserves_live_rows(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(30)}", s, int(rnd.random() < 0.6), f"v{s}") for s in range(1, 300)]
    upper = spark.createDataFrame([r for r in rows if r[1] > 120], LOG)
    lower = spark.createDataFrame([r for r in rows if r[1] <= 120 and r[0] < "k2"], LOG)
    files = pruning.file_table(lower.withColumn("file", F.lit(1)), "file")
    once = compaction.compact(upper, files)
    want = V.live(upper.unionByName(lower))
    got = V.live(once.unionByName(lower))
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    again = compaction.compact(once, files)
    assert again.exceptAll(once).isEmpty() and once.exceptAll(again).isEmpty()


def test_the_whole_deepest_tier_counts(spark, tmp_path):
    # of 100 events the first 30 are the deepest tier: 50 is only there, 60 has an older version there, 90 none
    users = {1: (50, "view"), 2: (60, "view"), 50: (60, "error"), 51: (90, "error")}
    rows = [(seq - 1, *users.get(seq, (5, "view")), float(seq)) for seq in range(1, 101)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    kept = {(r["key"], r["seq"], r["op"]) for r in Q.tombstone_gc(spark, str(tmp_path)).collect()}
    assert kept == {("0000000005", 100, 1), ("0000000060", 50, 0)}
    live = {(r["key"], r["seq"]) for r in Q.compaction_preserves_live(spark, str(tmp_path)).collect()}
    assert live == {("0000000005", 100), ("0000000050", 1)}


def test_bloom(spark):
    keys = spark.createDataFrame([(1, k) for k in ("hello", "world", "lsm", "engine")], "g int, key string")
    filters = pruning.bloom_build(keys, "g")
    assert all(r["maybe"] for r in pruning.bloom_probe(filters, keys, "g").collect())
    absent = spark.range(10_000).select(F.lit(1).alias("g"), F.concat(F.lit("missing_"), "id").alias("key"))
    assert pruning.bloom_probe(filters, absent, "g").filter("maybe").count() < 200
    empty = pruning.bloom_build(keys.limit(0), "g")
    assert pruning.bloom_probe(empty, keys, "g").filter("maybe").count() == 0


def test_find_file(spark):
    files = spark.createDataFrame([(1, "b", "d"), (2, "f", "h")], "file long, lo string, hi string")
    keys = spark.createDataFrame([(k,) for k in "abcdefghi"], "key string")
    got = {r["key"]: (r["file"], r["in_range"]) for r in pruning.find_file(files, keys).collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (1, True), "d": (1, True), "e": (2, False), "f": (2, True), "g": (2, True), "h": (2, True), "i": (None, False)}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_steps_against_brute_force(spark):
    import random

    from lodestrata.operators.asof import last_step
    from lodestrata.operators.compaction import coverage

    rnd = random.Random(8)
    keys = [f"{i:03d}" for i in range(200)]
    for n in (0, 1, 2, 60):
        files = []
        for i in range(n):
            a, b = sorted(rnd.choices(keys, k=2))
            files.append((i, a, b, rnd.randrange(1000)))
        table = spark.createDataFrame(files, "file long, lo string, hi string, seq_lo long")
        asked = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key string")
        found = last_step(asked, F.col("key"), coverage(table), "least")
        assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)
        got = sorted((r["key"], -1 if r["least"] is None else r["least"]) for r in found.collect())
        assert got == sorted((k, min((s for _, lo, hi, s in files if lo <= k <= hi), default=-1)) for k in keys + keys[:50])
        other = [(i, *sorted(rnd.choices(keys, k=2))) for i in range(40)]
        others = spark.createDataFrame(other, "file long, lo string, hi string")
        met = policy.overlapping_files(table, others)
        assert "NestedLoop" not in _plan(met)
        assert {r["file"] for r in met.collect()} == {i for i, lo, hi in other if any(a <= hi and lo <= b for _, a, b, _ in files)}


def test_compaction_and_file_search_without_nested_loops(spark):
    log = spark.createDataFrame([(f"k{i % 9}", i, i % 2, "v") for i in range(1, 60)], "key string, seq long, op tinyint, value string")
    files = pruning.file_table(log.withColumn("file", F.col("seq") % 4), "file")
    for df in (compaction.compact(log, files), compaction.compact(log, files, settled=30), pruning.find_file(files, log.select("key").distinct())):
        assert "NestedLoop" not in _plan(df) and df.count() > 0
