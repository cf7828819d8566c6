from lodestrata.llm.chat_format import collapse, format_chats, maximal

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in convs.items()}
    out = []
    for turns in set(convs.values()):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            same = [c for c, v in convs.items() if v == turns]
            out.append((min((c for c in same if c is not None), default=None), len(turns), len(same), render(turns)))
    return sorted(out, key=repr)


def chats():
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "bye")]
    rows = []
    for c, turns in enumerate([a[:1], a[:2], a, a, a[:3], [("user", "hi"), ("assistant", "other")], [("user", "hi")] * 3, [("assistant", "hello")], [(None, None)], [("", ""), ("", "")], [("user", "hihello")], [("user", "x" * 100_000)]]):
        rows += [(c, 10 * i, r, t) for i, (r, t) in enumerate(turns)]
    return rows + [(50, 1, "user", "hi"), (50, 1, "user", "hi"), (51, None, "user", "hi"), (51, 0, "assistant", "hello")]


def test_against_brute_force(spark):
    rows = chats()
    got = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "n_copies", "rendered").collect()), key=repr) == brute(rows)


def test_collapse_says_what_became_of_each(spark):
    got = {r["conv_id"]: (r["keep_id"], r["kept"]) for r in collapse(spark.createDataFrame(chats(), SCHEMA)).collect()}
    assert got[2] == (2, True) and got[3] == (2, False) and not got[0][1] and not got[4][1] and got[5][1]
    kept = {c for c, (_, k) in got.items() if k}
    assert kept == {r["conv_id"] for r in maximal(spark.createDataFrame(chats(), SCHEMA)).collect()}


def test_empty_null_ids_and_clashing_columns(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).isEmpty()
    rows = [(None, 0, "user", "a", 1, "x"), (None, 1, "user", "b", 2, "y"), (1, 0, "user", "a", 3, "z")]
    got = format_chats(spark.createDataFrame(rows, SCHEMA + ", pos int, keep_id string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["rendered"]) for r in got] == [(None, 2, render([("user", "a"), ("user", "b")]))]


def test_no_python(spark):
    plan = format_chats(spark.createDataFrame(chats(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
