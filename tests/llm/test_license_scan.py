import random
import re

import pytest

from lodestrata.llm.license_scan import NOTICES, PHRASES, TEMPLATES, Template, op10_license_scan, scan_licenses

FIELDS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    words = words_of(text)
    hits = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def pattern(template):
    """A template as a backtracking expression over ' word word ... '."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{(?:\d+-)?\d+\}\}|[0-9a-z]+", template.lower()):
        if part.startswith("{{"):
            low, _, high = part[2:-2].rpartition("-")
            out += f"(?:[^ ]+ ){{{low or 1},{high}}}"
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(part, part + " ")
    return re.compile("(?<= )" + out)


def method(text):
    """(labels, score) by those expressions."""
    line = " " + " ".join(words_of(text)) + " "
    whole = {label for label, t in TEMPLATES if pattern(t).search(line)}
    said = {label for label, t in NOTICES if pattern(t).search(line)}
    plain = set(filter(None, base(text)[4].split(",")))
    return ",".join(sorted(plain | said | whole)), 1.0 if whole else 0.75 if said else 0.5 if plain else 0.0


def written(template, rnd):
    """A text that the template accepts: markup chosen at random, odd case and punctuation."""
    words = ["*" if w == "*" else w for w in rnd.choice(forms_of(template))]
    return " ".join(rnd.choice([w, w.upper(), w.title(), f'"{w}",', f"{w}.\n"]) if w != "*" else rnd.choice(["Jane", "Doe", "2024", "é"]) for w in words)


def forms_of(template):
    """Some word sequences of a template, any word as '*'."""
    flat = re.sub(r"\{\{(?:(\d+)-)?(\d+)\}\}", lambda m: " ".join(["*"] * int(m[1] or 1)), template.lower())
    words = re.findall(r"\[\[|\]\]|\*|[0-9a-z]+", flat)
    without, depth = [], 0
    for w in words:
        depth += {"[[": 1, "]]": -1}.get(w, 0)
        if not depth and w not in ("[[", "]]"):
            without.append(w)
    return [without, [w for w in words if w not in ("[[", "]]")]]


def test_whole_licenses_and_broken_ones(spark):
    """Labels and scores against backtracking expressions: whole texts, and texts that lack or change words."""
    rnd, texts = random.Random(5), []
    for label, template in TEMPLATES:
        for _ in range(3):
            text = "Copyright (c) 2024 Jane Doe\n" + written(template, rnd)
            texts += [text, text + " more", "x" + text]
            words = text.split()
            for _ in range(3):
                cut = rnd.randrange(8, len(words) - 1)
                texts += [" ".join(words[:cut]), " ".join(words[:cut] + words[cut + 1 :]), " ".join([*words[:cut], "other", *words[cut:]])]
        assert Template(label, template).found_in(written(template, rnd).lower().encode())
        assert not Template(label, template).found_in(" ".join(written(template, rnd).split()[:-25]).lower().encode())
    texts += [t for _, t in NOTICES] + ["word " * 250_000 + texts[0], "permission is hereby " * 3000]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == method(t), t[:300]
    assert {s for _, s in got.values()} >= {0.0, 0.75, 1.0}
    assert {x for labels, _ in got.values() for x in labels.split(",")} >= {label for label, _ in TEMPLATES}


def accepts(template, text):
    return Template("x", template).found_in(text.lower().encode())


def test_markup():
    t = "redistribution [[and use]] of {{2}} is [[[[very]] well]] allowed {{0-1}} here"
    yes = ["Redistribution of X is allowed here", "(redistribution AND use, of a b; is well allowed -- here!)", "redistribution of x is very well allowed now here", "no redistribution redistribution of x is allowed here"]
    no = ["redistribution and of x is allowed here", "redistribution of is allowed here", "redistribution of a b c is allowed here", "redistribution of x is very allowed here", "redistribution of x is allowed a b here", "redistribution of x is allowed her", "xredistribution of x is allowed here", ""]
    assert [accepts(t, x) for x in yes] == [True] * len(yes)
    assert [accepts(t, x) for x in no] == [False] * len(no)


def expand(template):
    """All word sequences of a small template, any word as '*'."""
    parts = re.findall(r"\[\[|\]\]|\{\{(?:\d+-)?\d+\}\}|[^\s\[\]{}]+", template)

    def walk(i):
        if i == len(parts):
            return [[]]
        if parts[i] == "[[":
            depth, j = 1, i
            while depth:
                j += 1
                depth += {"[[": 1, "]]": -1}.get(parts[j], 0)
            inner = expand(" ".join(parts[i + 1 : j]))
            return [a + b for a in [[], *inner] for b in walk(j + 1)]
        if parts[i].startswith("{{"):
            low, _, high = parts[i][2:-2].rpartition("-")
            return [["*"] * n + b for n in range(int(low or 1), int(high) + 1) for b in walk(i + 1)]
        return [[parts[i]] + b for b in walk(i + 1)]

    return walk(0)


def test_automata_against_expansion():
    rnd = random.Random(8)
    for template in ("a [[b]] c", "a {{2}} b", "a [[b {{0-2}}]] c [[d]]", "a {{0-1}} [[[[b]] c]] {{1}} d"):
        forms = expand(template)
        for _ in range(300):
            text = [rnd.choice("abcd") for _ in range(rnd.randrange(9))]
            want = any(all(f in ("*", w) for f, w in zip(form, text[i:])) and len(text) - i >= len(form) for form in forms for i in range(len(text)))
            assert accepts(template, " ".join(text)) == want, (template, text)


def test_bad_markup():
    for bad in ("[[a]] b", "{{1}} b", "a [[b", "a b]]"):
        with pytest.raises((ValueError, IndexError)):
            Template("x", bad)


def test_rows(spark):
    texts = [None, "", "MIT License", "the mit-license, the Mit\nLicense; éMIT License", "mit licenses", "apache  license general public license", "Released under the MIT License.", "1 general public license", "no license", "mit license " * 3000, "\x00mit\x7flicense{"]
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(None, "mit license", 0, "y")]
    got = {r["doc_id"]: tuple(r)[1:] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")).select(*FIELDS).collect()}
    for i, t, _, _ in rows:
        assert got[i][:5] == base(t), t
        assert set(filter(None, got[i][4].split(","))) <= set(filter(None, got[i][5].split(",")))
        assert got[i][5:] == method(t), t
    assert got[6][5] == "mit,mit-notice"
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_query(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_license_scan(spark, sf_dir).select(*FIELDS).collect()}
    want = {r["doc_id"]: (*base(r["text"]), *method(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got == want and any(w[1] for w in want.values())
