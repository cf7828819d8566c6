import random
import struct
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrata.llm.bpe import Bpe, decode, encode, op3_bpe, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Bpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def same(own, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text[:80])
    assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


def test_random_texts(own, theirs):
    rnd = random.Random(3)
    pool = [*map(chr, range(0x250)), *"  　一\U0001f600١Ⅰ́﻿"]
    for _ in range(1500):
        text = "".join(rnd.choice(pool[:128] if rnd.random() < 0.7 else pool) for _ in range(rnd.randrange(60)))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + rnd.choice(["  ", " \n", "\n ", "　 ", "\x85", "<|endoftext|>", "'ll ", " don't"]) + text[at:]
        same(own, theirs, text)


def test_long_and_repetitive_texts(own, theirs):
    for text in ("a" * 5000, " " * 3000, "ab" * 3000 + " ", "\n" * 100 + "x", "!" * 777, "the " * 9000, "", "<|endoftext|>" * 3):
        same(own, theirs, text)


def test_whole_documents(own, theirs, sf_dir):
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist():
        same(own, theirs, text)


def test_ids_that_are_no_text(own, theirs):
    rnd = random.Random(4)
    for _ in range(300):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(8))]
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(theirs, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.bpe.REMEMBER", 3)
    bpe = Bpe(open(PATH, encoding="utf-8").read())
    same(bpe, theirs, "one two three four five six one two three\nfour five " * 5)


def test_frames(spark, theirs, sf_dir):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello  world", "z"), (3, "hello  world", "z"), (None, "é" * 10, "z"), (4, "a b " * 40_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode(docs)
    want = sorted(((i, theirs.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == want
    assert sorted(((r["doc_id"], r["text"]) for r in decode(encoded).collect()), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    digests = {r["doc_id"]: r for r in round_trip_digests(docs).collect()}
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[i]["decoded_sha256"] == sha256((t or "").encode()).hexdigest()
    assert round_trip_digests(docs.limit(0)).isEmpty()


def test_query(spark, theirs, sf_dir):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in op3_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = theirs.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
