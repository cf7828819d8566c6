import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import pytest

from lodestrata.llm import katz
from lodestrata.llm.katz import fit, good_turing, op9_katz_lm, score

END, START = "</end>", "<start>"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Brute:
    """The same model in dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if not self.held(i)]
        self.uni = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.bi = Counter(p for t in train for p in zip([START, *t], t))
        self.of, self.after = Counter(), defaultdict(list)
        for (h, w), c in self.bi.items():
            self.of[h] += c
            self.after[h].append(w)
        self.du, self.db = self.discounts(self.uni), self.discounts(self.bi)
        left = sum(c - self.du(c) * c for c in self.uni.values())
        self.more = int(left <= 1e-12)
        self.unknown = (1 if self.more else left) / max(self.n + self.more, 1)
        self.weights = {}

    @staticmethod
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 10 == 0

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        d = good_turing([n[r] for r in range(1, 7)])
        return lambda c: d[c] if c <= 5 else 1.0

    def word(self, w):
        c = self.uni[w]
        return self.du(c) * c / (self.n + self.more) if c else self.unknown

    def weight(self, h):
        if h not in self.weights:
            counts = [self.bi[h, w] for w in self.after[h]]
            left = sum(c - self.db(c) * c for c in counts)
            more = int(left <= 1e-12)
            self.weights[h] = ((1 if more else left) / (self.of[h] + more) / (1 - sum(map(self.word, self.after[h]))), more)
        return self.weights[h]

    def prob(self, h, w):
        if h not in self.of:
            return self.word(w)
        alpha, more = self.weight(h)
        c = self.bi[h, w]
        return self.db(c) * c / (self.of[h] + more) if c else alpha * self.word(w)

    def row(self, i, text):
        t = tokens(text)
        base = sum(log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return self.held(i), len(t), sum(self.uni[w] > 0 for w in t), self.n, base, sum(log10(self.prob(h, w)) for h, w in zip([START, *t], t))


def check(got, rows):
    model = Brute(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(tuple(r)[1:])
    assert sum(map(len, by.values())) == len(rows)
    for i, text in rows:
        want = model.row(i, text)
        assert any(g[:4] == want[:4] and isclose(g[4], want[4], rel_tol=1e-9, abs_tol=1e-9) and isclose(g[5], want[5], rel_tol=1e-7, abs_tol=1e-7) for g in by[i]), (i, want, by[i])
    return model


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op9_katz_lm(spark, sf_dir).collect()
    model = check(got, rows)
    for h in [START, "the", *list(model.of)[:20]]:  # exactly normalised, unknown class included
        assert isclose(sum(model.prob(h, w) for w in model.uni) + model.prob(h, "never seen"), 1, rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("texts", [
    ["a b a b a b c", "A b", "", None, "a b c d e f", "z z z z z z z z", "new words only", "a a a a a a a b b b b b b b"] * 4,
    ["w"] * 40,
    ["the x%d the the y%d the" % (i, i % 3) for i in range(60)] + ["word " * 50_000],
])
def test_small_corpora(spark, texts):
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "again a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(score(fit(docs)).collect(), rows)


def test_wide_histories_are_dealt_and_added_up(spark, monkeypatch):
    rows = [(i, " ".join(f"the w{(i * j) % 41}" for j in range(1, 30))) for i in range(60)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.numbers.wide
    check(score(model).collect(), rows)


@pytest.mark.parametrize("known, asked", [(1, 1), (6, 40), (6, 1), (50, 3)])
def test_short_texts_with_new_words(spark, known, asked):
    """Held-out texts that begin with words that START was not seen with, on few and short texts."""
    train, held = [i for i in range(3000) if not Brute.held(i)][:known], [i for i in range(3000) if Brute.held(i)][:asked]
    rows = [(i, f"a{i % 4} b{i % 3}") for i in train] + [(i, f"new{i} a1 b2 old b{i % 3}" if i % 2 else "a1 new") for i in held]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, held int").repartition(5)
    check(score(fit(docs)).collect(), rows)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if Brute.held(i)][:3]
    rows = [(i, "a b") for i in held]
    check(score(fit(spark.createDataFrame(rows, "doc_id long, text string"))).collect(), rows)
    assert score(fit(spark.createDataFrame([], "doc_id long, text string, chunk int"))).isEmpty()


def test_packed_arrays_come_back():
    import numpy as np

    for x in (np.array([], np.int64), np.array([5], np.uint32), np.arange(1000, dtype=np.uint64) * 77):
        assert katz._unpack(katz._pack(x), x.dtype).tolist() == x.tolist()
    pairs = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert katz._unpack_pairs(katz._pack_pairs(pairs)).tolist() == pairs.tolist()
