import random
from collections import defaultdict

from lodestrata.llm import token_counts
from lodestrata.llm.token_counts import BPE, RollupStore, counted, counted_bpe, op4_token_counts

SCHEMA = "doc_id long, source string, lang string, tokenizer string, op string, tokens long, order int"


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def rollup(model):
    out = {}
    for (_, tokenizer), (source, lang, n) in model.items():
        d, t = out.get((source, lang, tokenizer), (0, 0))
        out[source, lang, tokenizer] = (d + 1, t + n)
    return out


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rnd, model = random.Random(4), {}
    store = RollupStore(spark, f"file://{tmp_path}/r")
    for b in range(6):
        rows = {}
        for i in range(rnd.randrange(1, 40)):
            key = (rnd.randrange(25), rnd.choice(["v1", "v2"]))
            op = rnd.choice(["insert", "revise", "delete"])
            rows[key] = (key[0], rnd.choice(["s1", "s2", None]), rnd.choice(["en", None]), key[1], op, rnd.choice([0, 5, None, 100]), i)
        for key, (_, source, lang, _, op, n, _) in rows.items():
            old = model.get(key)
            if op == "delete":
                model.pop(key, None)
            elif op == "insert":
                model[key] = (source, lang, n or 0)
            elif old:
                model[key] = (old[0] if source is None else source, old[1] if lang is None else lang, n or 0)
            elif source is not None or lang is not None:
                model[key] = (source, lang, n or 0)
        frame = spark.createDataFrame(list(rows.values()) * 2, SCHEMA)  # repeated rows count once
        assert store.apply(f"b{b}", frame, order="order") and not store.apply(f"b{b}", frame, order="order")
        assert totals(store) == rollup(model), b
        if b == 3:
            store.compact()
    assert totals(RollupStore(spark, f"file://{tmp_path}/r")) == rollup(model)
    live = {(r["doc_id"], r["tokenizer"]): (r["source"], r["lang"], r["tokens"]) for r in store.live().collect()}
    assert live == model


def test_the_last_change_of_a_batch_holds(spark, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/r")
    rows = [(1, "s", "en", "v", "insert", 5, 1), (1, "s", "en", "v", "delete", 0, 2), (1, "s", "en", "v", "insert", 7, 3), (None, "s", "en", "v", "insert", 9, 1), (2, "s", "en", None, "insert", 9, 1)]
    store.apply("b", spark.createDataFrame(rows, SCHEMA), order="order")
    assert totals(store) == {("s", "en", "v"): (1, 7)}


def test_empty(spark, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/r")
    assert totals(store) == {}
    store.apply("b", spark.createDataFrame([], SCHEMA))
    assert totals(store) == {} and store.live().isEmpty()


def test_query_against_the_tokenizers_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    poor = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = r["text"] or ""
        if r["doc_id"] not in poor:
            for name, n in ((BPE, len(library.encode(text, add_special_tokens=False).ids)), ("bytes-1", len(text.encode())), ("words-1", len(text.encode().split()))):
                want[r["source"], r["lang"], name][0] += 1
                want[r["source"], r["lang"], name][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in op4_token_counts(spark, sf_dir).collect()}
    assert got == dict(want)


def test_odd_texts_and_columns(spark, tmp_path):
    rows = [(1, None, None, "s", 1, "a"), (2, "", "en", None, 2, "b"), (3, "ab " * 300_000, "en", "s", 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long, `order` string").selectExpr("*", "'x' as op", "1 as docs", "2 as tokenizer")
    plain = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in counted(docs).collect()}
    assert plain == {(1, "bytes-1"): 0, (1, "words-1"): 0, (2, "bytes-1"): 0, (2, "words-1"): 0, (3, "bytes-1"): 900_000, (3, "words-1"): 300_000}
    assert {r["doc_id"]: r["tokens"] > 0 for r in counted_bpe(docs).collect()} == {1: False, 2: False, 3: True}
    store = RollupStore(spark, f"file://{tmp_path}/r")
    # a column `order` of the caller's decides nothing unless it is named
    changes = spark.createDataFrame([(1, "s", "en", "v", "insert", 5, 9, 1, "q"), (1, "s", "en", "v", "insert", 7, 1, 2, "r")], "doc_id long, source string, lang string, tokenizer string, op string, tokens long, `order` int, _order int, c string")
    store.apply("b", changes)
    assert totals(store) == {("s", "en", "v"): (1, 7)}
    store.apply("c", changes, order="order")
    assert totals(store) == {("s", "en", "v"): (1, 5)}


def _insert(spark, i, n):
    return spark.createDataFrame([(i, "s", "en", "v", "insert", n)], "doc_id long, source string, lang string, tokenizer string, op string, tokens long")


def test_a_writer_that_dies_leaves_no_torn_commit(spark, tmp_path, monkeypatch):
    store = RollupStore(spark, f"file://{tmp_path}/r")
    store.apply("a", _insert(spark, 1, 5))
    (tmp_path / "r" / "_manifest" / ".half").write_text("{")  # what a dying writer leaves
    store._log.files.overwrite(f"{store.path}/ledger/half/part-0.parquet", b"PAR1")
    store.apply("b", _insert(spark, 2, 6))
    assert totals(RollupStore(spark, store.path)) == {("s", "en", "v"): (2, 11)}


def test_two_writers_both_commit(spark, tmp_path, monkeypatch):
    one, two = (RollupStore(spark, f"file://{tmp_path}/r") for _ in range(2))
    commit, raced = one._commit, []

    def late(*args, **more):
        if not raced:
            raced.append(two.apply("two", _insert(spark, 1, 50)))
        return commit(*args, **more)

    monkeypatch.setattr(one, "_commit", late)
    assert one.apply("one", _insert(spark, 1, 7)) and raced == [True]
    assert totals(two) == {("s", "en", "v"): (1, 7)} and not two.apply("one", _insert(spark, 1, 9))
    assert {r["tokens"] for r in two.live().collect()} == {7}


def test_commits_are_checkpointed_and_ids_stay_known(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "CHECKPOINT_EVERY", 3)
    store = RollupStore(spark, f"file://{tmp_path}/r")
    for i in range(5):
        assert store.apply(f"b{i}", _insert(spark, i, i))
    store.compact()
    again = RollupStore(spark, store.path)
    assert not any(again.apply(f"b{i}", _insert(spark, i, 99)) for i in range(5))
    assert totals(again) == {("s", "en", "v"): (5, 10)}


def test_a_batch_sums_only_the_ledger_of_its_keys(spark, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/r")
    store.apply("a", spark.range(1000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "'v' as tokenizer", "'insert' as op", "1 as tokens"))
    plan = store.live_of(store._changes(_insert(spark, 5, 2), None), store.state())._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    aggregate, semi = next(i for i, x in enumerate(lines) if "Aggregate" in x), next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert aggregate < semi and "doc_id" in lines[semi + 1] and ">= 5" in plan and "<= 5" in plan
