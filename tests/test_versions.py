"""Version operators on small logs, against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import versions as V

SCHEMA = "key string, seq bigint, op tinyint, value string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def model(rows, snapshot=None):
    newest = {}
    for key, seq, op, value in rows:
        if (snapshot is None or seq <= snapshot) and seq > newest.get(key, (0,))[0]:
            newest[key] = (seq, op, value)
    return {k: v for k, (_, op, v) in newest.items() if op == 1}


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    keys = ["", "a", "ab", "1234567", "12345678", "0123456789abcdef", "é", "z\x7f", *(f"k{i}" for i in range(20))]
    out = []
    for seq in range(1, 400):
        op = int(rnd.random() < 0.7)
        out.append((rnd.choice(keys), seq, op, rnd.choice(["", "v", f"v{seq}"]) if op else None))
    return out


def test_versions_of_a_key_at_snapshots(spark):
    log = frame(spark, [("foo", 1, 1, "v1"), ("bar", 2, 1, "v2"), ("foo", 4, 1, "v3"), ("foo", 6, 0, None)])
    assert as_dict(V.get(log, "foo", 3)) == {"foo": "v1"}
    assert as_dict(V.get(log, "bar", 3)) == {"bar": "v2"}
    assert as_dict(V.get(log, "foo", 5)) == {"foo": "v3"}
    assert as_dict(V.get(log, "foo", 7)) == {}
    assert [r["seq"] for r in V.history(log, "foo").collect()] == [6, 4, 1]


@pytest.mark.parametrize("snapshot", [None, 1, 57, 200])
def test_live_is_the_model(spark, rows, snapshot):
    log = frame(spark, rows).repartition(5)
    assert as_dict(V.live(log, snapshot)) == model(rows, snapshot)


def test_head_by_aggregate_is_head_by_rank(spark, rows):
    log = frame(spark, rows)
    a, b = V.head(log), V.head_by_rank(log).select("key", "seq", "op", "value")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_scans(spark, rows):
    log, want = frame(spark, rows), model(rows)
    order = sorted(want, key=str.encode)
    assert [r["key"] for r in V.scan(log).collect()] == order
    assert [r["key"] for r in V.scan(log, reverse=True).collect()] == order[::-1]
    assert [r["key"] for r in V.scan(log, "b", "k15").collect()] == [k for k in order if b"b" <= k.encode() < b"k15"]
    assert [r["key"] for r in V.prefix_scan(log, "k1").collect()] == [k for k in order if k.startswith("k1")]
    assert [r["key"] for r in V.seek(log, "k").collect()] == [k for k in order if k >= "k"][:1]
    assert V.seek(log, "\U0010ffff").isEmpty()
    assert [r["key"] for r in V.page(log, 3, after=order[2]).collect()] == order[3:6]
    assert [r["key"] for r in V.page(log, 3, before=order[6]).collect()] == order[3:6][::-1]
    ranked = {r["key"]: r["pos"] for r in V.positioned(V.live(log)).collect()}
    assert ranked == {k: i + 1 for i, k in enumerate(order)}


def test_multi_get_keeps_misses(spark, rows):
    want = model(rows)
    asked = ["a", "k1", "k2", "nope", "k1"]
    got = {r["key"]: (r["found"], r["value"]) for r in V.multi_get(frame(spark, rows), spark.createDataFrame([(k,) for k in asked], "key string")).collect()}
    assert got == {k: (k in want, want.get(k)) for k in asked}


def test_random_tiers_give_the_same_live_rows(spark, rows):
    tiers = [frame(spark, rows[i::3]) for i in range(3)]
    assert as_dict(V.live(V.merge(tiers))) == model(rows)
    recency = [(*r, 4 - r[1] // 100) for r in rows]
    log = spark.createDataFrame(recency, SCHEMA + ", tier int")
    assert as_dict(V.head_by_tier(log).filter("op = 1")) == model(rows)


def test_compatibility_scans(spark):
    log = frame(spark, [("a", 1, 1, "1"), ("a", 2, 0, None), ("a", 3, 1, "3"), ("a", 4, 1, "4"), ("", 5, 1, "5"), ("", 6, 1, "6"), ("b", 7, 0, None)])
    assert sorted(r["value"] for r in V.puts_above_newest_delete(log).collect()) == ["3", "4", "6"]
    assert sorted(r["value"] for r in V.all_puts(log).collect()) == ["1", "3", "4", "5", "6"]


def test_sequence_is_consecutive(spark):
    rows = spark.range(1000).select((999 - F.col("id")).alias("t"), F.lit("k").alias("key"))
    got = V.assign_sequence(rows, ["t"], base=10).orderBy("t").select("t", "seq").collect()
    assert [r["seq"] for r in got] == list(range(11, 1011))


def test_empty_log(spark):
    log = frame(spark, [])
    assert V.live(log).isEmpty() and V.positioned(V.live(log)).isEmpty() and V.scan(log).isEmpty()


def test_key_filter_reaches_the_scan(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = V.live(log).filter("key = 'k1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k1)" in plan


def test_positions_and_numbers_of_many_rows(spark, tmp_path):
    n = 1_000_000
    wide = spark.range(n, numPartitions=6).select(F.concat(F.lit("k"), F.lpad((F.col("id") * 7919 % n).cast("string"), 8, "0")).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("tinyint").alias("op"), F.sha2(F.col("id").cast("string"), 256).alias("value"), (F.col("id") % 1000).alias("day"))
    wide.write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    for found, name in ((V.positioned(rows), "pos"), (V.assign_sequence(rows.drop("seq"), ["day", "key"], base=10), "seq"), (V.assign_sequence(rows.drop("seq"), base=10), "seq")):
        base = 10 if name == "seq" else 0
        assert found.agg(F.count("*"), F.countDistinct(name), F.min(name), F.max(name)).first()[:] == (n, n, base + 1, base + n)
    found = V.positioned(rows, descending=True)
    assert found.filter(F.col("pos") != n - F.substring("key", 2, 8).cast("long")).isEmpty()
    found = V.assign_sequence(rows.drop("seq"), ["day", "key"])
    found.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter(F.col("day") != F.floor((F.col("seq") - 1) / 1000)).isEmpty()
