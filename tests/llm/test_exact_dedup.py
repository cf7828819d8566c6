import hashlib
import random

import pytest

from lodestrata.llm.exact_dedup import CuckooIndex, content_digests, exact_dedup, keep_one, update_index

WHITE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(WHITE), []).append((-len(t or ""), i is None, i or 0))
    keep = {k: min(v) for k, v in groups.items()}
    out, done = [], set()
    for i, t in rows:
        k = (t or "").translate(WHITE)
        best = None if keep[k][1] else keep[k][2]
        # of rows alike in id and text one stays
        kept = k not in done and (-len(t or ""), i is None, i or 0) == keep[k]
        done |= {k} if kept else set()
        out.append((i, best, len(groups[k]), kept, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    got = exact_dedup(spark.createDataFrame(rows, schema)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n", "a b", "ab", "a b", "a  b ", "éé", "é é\t", "x" * 200_000, "same"]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(1000 + i, "hot text") for i in range(200)]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a"), (5, "a "), (5, "a "), (None, "b"), (None, "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    rows = [(1, "a", b"x", 7, True), (2, "a", b"y", 8, False)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, digest binary, group_size long, kept boolean"))
    assert sorted((r["doc_id"], r["kept"]) for r in got.collect()) == [(1, True), (2, False)]


def test_keep_one_keeps_rows(spark):
    """Whole rows, also where ids are null or repeated and columns have names of its own."""
    rows = [(None, "a", 1), (5, "a ", 2), (5, "a ", 3), (None, "b", 4), (None, "b", 5), (7, "c", 6), (7, "d", 7), (8, "d", 8), (None, None, 9), (9, " ", 10)]
    rows += [(None, "hot", i) for i in range(20, 220)] + [(300, "x" * 300_000, 11), (301, "x" * 300_000 + "\n", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int").repartition(4)
    got = keep_one(docs).collect()
    assert [r["_key"] for r in got if r["text"] == "hot"] and len(got) == 7
    left = sorted(("x" if len(r["text"] or "") > 99 else r["text"], r["doc_id"]) for r in got if r["text"] not in ("b", "hot"))
    assert left == sorted([("a ", 5), ("c", 7), ("d", 7), (" ", 9), ("x", 301)])
    assert keep_one(docs.limit(0)).isEmpty()


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_index_insert_delete_resize():
    rnd, index, model = random.Random(2), CuckooIndex(buckets=2), {}
    for step in range(20_000):
        k = key(rnd.randrange(3_000))
        if rnd.random() < 0.65:
            entry = index.get(k)
            assert (entry is not None) == (k in model)
            (entry or index.insert(k, 0))[1] = step
            model[k] = step
        else:
            assert index.delete(k) == (model.pop(k, None) is not None)
    assert len(index) == len(model) and {e[0]: e[1] for e in index.live()} == model
    assert index.buckets > 2


def test_equal_fingerprints_are_verified():
    index = CuckooIndex()
    a, b = b"\x00" * 32, b"\x00" * 31 + b"\x01"  # the same place and fingerprint
    index.insert(a, "a")
    assert index.get(b) is None
    index.insert(b, "b")
    assert index.get(a)[1] == "a" and index.get(b)[1] == "b"
    assert index.delete(a) and index.get(a) is None and index.get(b)[1] == "b"


def test_index_of_live_digests(spark):
    docs = lambda texts: content_digests(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    index = update_index(None, docs(["a", "a ", "b", "c"]), None)
    index = update_index(index, docs(["d"]), docs(["a", "b", "never"]))
    name = {hashlib.sha256(t.encode()).digest(): t for t in "abcd"}
    assert {name[bytes(r["digest"])[:32]]: r["live"] for r in index.collect()} == {"a": 1, "c": 1, "d": 1}


@pytest.mark.parametrize("name", ["op1_packing", "op5_exact_dedup", "op6_chat_format", "rollup_plain", "op2_embedding_dedup", "op7_ngram_jaccard"])
def test_queries_against_sql(name, spark, duck, sf_dir):
    from lodestrata.llm.queries import ORACLES, QUERIES

    from ..conftest import same_rows

    got, want = same_rows(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))
    assert got == want
