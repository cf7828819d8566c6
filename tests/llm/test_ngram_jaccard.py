import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import ngram_jaccard
from lodestrata.llm.hashing import mix, shingle_sets, word_hashes
from lodestrata.llm.ngram_jaccard import InvertedIndex, similar_documents
from lodestrata.llm.signatures import signatures


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "a", "of"] + [f"w{rnd.randrange(3000)}" for _ in range(5)])
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n ", "one", "One", "one two", "ONE\ttwo", "one two three", "x " * 3000]
    for g in range(25):
        base = [word() for _ in range(rnd.choice([5, 12, 20, 60, 150, 400]))]
        if g % 5 == 0:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(5)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, len(base) // 25, len(base) // 12])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append((" " if rnd.random() < 0.7 else "\n").join(copy))
            base = copy if rnd.random() < 0.4 else base  # chains
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def run(spark, rows, size, percent):
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, percent)
    return sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, size, percent):
    rows = corpus(size) + [(None, "one two three"), (None, None), (1, "one")]
    assert run(spark, rows, size, percent) == brute(rows, size, percent)


def test_a_large_family_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SHARD_MEMBERS", 8)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows, copy = [], list(base)
    for i in range(60):
        if i % 3 == 0:  # a chain whose ends aren't similar to the hub, and copies of the hub
            copy = list(copy)
            copy[(i * 2) % 120] = f"c{i}"
        rows.append((i, " ".join(copy if i % 3 == 0 else [*base[: i % 5], f"n{i}", *base[i % 5 + 1 :]])))
    rnd.shuffle(rows)
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], 3, 90) == []
    docs = spark.createDataFrame([(1, "a b c d", 1, "x"), (2, "a b c d", 2, "y")], "doc_id long, text string, rep int, n string")
    assert sorted(tuple(r) for r in similar_documents(docs, 3, 90).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_t_occurrence_search():
    rnd = np.random.default_rng(4)
    sets = []
    for g in range(12):
        base = mix(rnd.integers(0, 400 + g, rnd.integers(1, 80)).astype(np.uint64))
        for _ in range(6):
            sets.append(np.unique(np.where(rnd.random(len(base)) < 0.06, mix(rnd.integers(0, 500, len(base)).astype(np.uint64)), base)))
    for num in (60, 80, 90, 100):
        index = InvertedIndex(sets, num, 100)
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= num * len(np.union1d(q, s))]
            assert index.search(q).tolist() == want


def test_signatures_of_similar_sets_meet():
    rnd = np.random.default_rng(5)
    for threshold in (0.9, 0.8):
        met = 0
        for _ in range(1500):
            n = int(rnd.integers(1, 300))
            a = mix(rnd.integers(0, 2**60, n).astype(np.uint64))
            b = np.concatenate([a[rnd.random(n) < rnd.uniform(threshold - 0.03, 1)], mix(rnd.integers(0, 2**60, int(rnd.integers(0, n // 5 + 2))).astype(np.uint64))])
            a, b = np.unique(a), np.unique(b)
            if len(b) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= threshold:
                met += 1
                assert len(np.intersect1d(signatures(a, threshold), signatures(b, threshold)))
        assert met > 100


def test_sets_dealt_again_meet_and_seldom_share_the_last_signature(monkeypatch):
    from lodestrata.llm import signatures as module

    rnd = np.random.default_rng(9)
    last = mix(np.array([(b << 32) + 0xFFFFFFFF for b in range(200)], np.uint64))
    # nothing is spared, so that most sets are dealt again, and some in every dealing
    monkeypatch.setattr(module, "bands", lambda t, whole=module.bands: (whole(t)[0], [(p - s, 0) for p, s in whole(t)[1]]))
    again = ended = 0
    for _ in range(600):
        n = int(rnd.integers(10, 200))
        a = np.unique(mix(rnd.integers(0, 2**60, n).astype(np.uint64)))
        b = a[rnd.random(len(a)) < 0.92]
        x = module.signatures(a, 0.8)
        ended += bool(np.isin(x, last).any())
        monkeypatch.setattr(module, "DEALINGS", 1)
        again += bool(np.isin(module.signatures(a, 0.8), last).any())
        monkeypatch.setattr(module, "DEALINGS", 6)
        if len(b) >= 0.8 * len(a):
            assert len(np.intersect1d(x, module.signatures(b, 0.8)))
    assert again and ended < again


def test_word_hashes_at_piece_borders(monkeypatch):
    import lodestrata.llm.hashing as h

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abAB é\n\t\x0b\x1c") for _ in range(rnd.randrange(200))) for _ in range(60)] + ["", "x" * 500, None]
    want, counts = word_hashes(pa.array(texts))
    monkeypatch.setattr(h, "PIECE", 16)
    got, same = word_hashes(pa.array(texts))
    assert got.tolist() == want.tolist() and same.tolist() == counts.tolist()
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert len(words) == len(want)
    assert len(set(zip(words, want.tolist()))) == len(set(words)) == len(set(want.tolist()))
    assert [len(s) for s in shingle_sets(pa.array(texts), 3)] == [len(shingles(t, 3)) for t in texts]
    part = pa.array(["skip", *texts])[1:]
    assert word_hashes(part)[0].tolist() == want.tolist()


def test_rows_are_kept_apart_whatever_their_ids(spark, tmp_path):
    """Files of several row groups, and a frame that isn't a file: the same rows stay."""
    from lodestrata.llm.common import row_numbered
    from lodestrata.llm.ngram_jaccard import keep_one_of_similar

    base = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(40)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t + f" tail{c}" * (c > 0), k) for k, t in enumerate(base) for c in range(3)]
    rows += [(None, None, 100), (7, "", 101), (None, "one", 102), (7, "one", 102)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    numbers = row_numbered(files, "n")
    assert numbers.select("n").distinct().count() == len(rows)
    again = row_numbered(files.repartition(3).select("*"), "n")  # stored, not read as files
    assert again.select("n").distinct().count() == len(rows)
    for frame in (docs, files):
        kept = keep_one_of_similar(frame, 5, 80)
        assert kept.columns == ["doc_id", "text", "_row"]
        got = sorted((r["_row"], r["doc_id"] is None) for r in kept.collect())
        assert got == sorted([(k, k % 3 == 0) for k in range(40)] + [(100, True), (101, False), (102, False)])


@pytest.mark.parametrize("light", [256, 3])
def test_sets_chained_by_single_signatures_do_not_ask_everywhere(spark, monkeypatch, light):
    """Texts of common passages share signatures by chance, and are similar to few."""
    rnd, guests, stored = random.Random(12), [], ngram_jaccard.stored

    def counted(df, name):
        out = stored(df, name)
        guests.extend([out.count()] if name == "guests" else [])
        return out

    monkeypatch.setattr(ngram_jaccard, "stored", counted)
    monkeypatch.setattr(ngram_jaccard, "SHARD_MEMBERS", 8)
    monkeypatch.setattr(ngram_jaccard, "LIGHT", light)
    pool = [[f"p{k}w{j}" for j in range(14)] for k in range(24)]
    texts = [sum(rnd.sample(pool, rnd.choice([5, 6, 7])), []) for _ in range(70)]
    for k in range(0, 70, 7):  # few have near copies, of them and of their copies
        copy = list(texts[k])
        for i in range(3):
            copy = [*copy, f"c{k}i{i}", f"d{k}i{i}"]
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(spark, rows, 3, 80) == brute(rows, 3, 80)
    if light == 256:
        assert sum(guests) < len(rows)  # each of the chain asked in all of its shards


def test_similar_sets_share_the_full_parts_that_no_difference_touches():
    from lodestrata.llm.signatures import full_parts

    rnd = np.random.default_rng(8)
    met = 0
    for _ in range(1500):
        n = int(rnd.integers(1, 400))
        a = mix(rnd.integers(0, 2**60, n).astype(np.uint64))
        b = np.concatenate([a[rnd.random(n) < rnd.uniform(0.8, 1)], mix(rnd.integers(0, 2**60, int(rnd.integers(0, n // 8 + 2))).astype(np.uint64))])
        a, b = sorted((np.unique(a), np.unique(b)), key=len)
        if len(a) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            met += 1
            shared = len(np.intersect1d(signatures(a, 0.8), signatures(b, 0.8)))
            assert shared >= max(1, full_parts(a, 0.8) - (len(a) + len(b)) * 20 // 180)
    assert met > 100
