import corpus_pipeline
from lodestrata.llm.exact_dedup import WHITE

from .test_ngram_jaccard import brute


def test_every_stage_does_its_work(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows["quality"]}
    wrong = sum((i in kept) != bool(q) for i, q in labels.items())
    assert wrong <= 0.1 * len(labels)
    plain = lambda t: t.encode().translate(None, WHITE)
    best = {}
    for r in rows["quality"]:
        key = (-len(r["text"]), r["doc_id"])
        best[plain(r["text"])] = min(best.get(plain(r["text"]), key), key)
    assert {r["doc_id"] for r in rows["dedup"]} == {i for _, i in best.values()}
    want = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in rows["dedup"]], 5, 80) if d == c}
    assert {r["doc_id"] for r in rows["near_dedup"]} == want
    assert {r["doc_id"] for r in rows["packing"]} == want and len(rows["packing"]) == len(want)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows["packing"]))


def test_stages_take_odd_tables(spark, sf_dir):
    rows = [(None, None, "en", "s", 1), (1, "", "en", None, None), (1, "", "en", None, None), (2, "a b c " * 40_000, None, "s", 3), (3, " a b c d e f", "en", "s", 4), (4, "a b c d e f ", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as rep", "2 as kept", "3 as _kept_id", "4 as component_id")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() is not None
        assert stage(spark, docs.limit(0), sf_dir).isEmpty()
    assert {r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, sf_dir).collect() if r["doc_id"] in (3, 4)} == {3}
