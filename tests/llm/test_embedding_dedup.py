import random

import numpy as np
import pytest

from lodestrata.llm.components import connected_components
from lodestrata.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    good = []
    for i, (v, e, label) in enumerate(rows):
        ok = v is not None and label is not None and e and None not in e and np.isfinite(e).all() and any(e)
        good.append(np.array(e, np.float32).astype(float) if ok else None)
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        part = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((v, len(links[i]), part, v == part))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA, **more):
    got = near_duplicates(spark.createDataFrame(rows, schema).repartition(3), **more)
    return sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(7)
    out = []
    centres = rnd.normal(size=(12, 16))
    for i in range(260):
        c = centres[i % 12]
        out.append((i, (c + rnd.normal(size=16) * rnd.choice([0.02, 0.15, 0.5])).astype(np.float32).tolist(), int(i % 3)))
    out += [(1000 + i, [1.0] * 16, 1) for i in range(60)]  # a group of copies
    chain = [(2000 + i, [float(np.cos(i * 0.19)), float(np.sin(i * 0.19))] + [0.0] * 14, 2) for i in range(15)]
    return out + chain


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("blocks_a_group", [1, 3])
def test_small_blocks(spark, rows, monkeypatch, blocks_a_group):
    import lodestrata.llm.embedding_dedup as e

    monkeypatch.setattr(e, "LEAF", 4)
    assert run(spark, rows, block=7, group_bytes=blocks_a_group * 7 * 8 * 16) == brute(rows)
    assert run(spark, rows, threshold=0.9) == brute(rows, 0.9)


def test_a_dense_region_sends_a_block_once_to_a_pair_of_groups(spark):
    import lodestrata.llm.embedding_dedup as e

    rnd = np.random.default_rng(3)
    near = [(i, (np.ones(8) + 0.01 * rnd.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(320)]
    frame = spark.createDataFrame(near, SCHEMA).selectExpr("vec_id as rep", "1L as copies", "cast(label as long) label", "cast(embedding as array<double>) embedding")
    epsilon = 0.2
    blocks = e.stored(e.grid_blocks(e._place(frame, e._rotations(frame)), epsilon, 10, 4 * 10 * 8 * 8), "blocks")
    n, groups = blocks.count(), blocks.select("team").distinct().count()
    assert n >= 32 and groups <= n / 2
    pairs = e.block_pairs(blocks, epsilon).count()
    sent = e.group_pairs(blocks, epsilon).count()
    assert pairs == n * (n + 1) // 2 and sent <= n * groups  # by pairs of blocks it would be twice the pairs
    assert run(spark, near, block=10, group_bytes=4 * 10 * 8 * 8) == brute(near)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 1.0, 1.0], [1e-30, 1e-30], [3e38, 3e38], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(i, e, label) for i, (e, label) in enumerate((e, label) for e in odd for label in (0, None))] + [(None, [1.0, 1.0], 0), (500, [1.0, 1.0], 0), (500, [1.0, 1.0], 0)]
    got, want = run(spark, rows), brute([(v, e, label) for v, e, label in rows])
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert (None, 0, None, True) in got


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    got = near_duplicates(spark.createDataFrame([(1, [1.0], 0, 5, "x"), (2, [2.0], 0, 6, "y")], SCHEMA + ", n_links int, rep string"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 1)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 860)] + [(3, 3), (None, 4)]
    part = {}
    for u, v in edges:
        if u is not None:
            a, b = part.setdefault(u, {u}), part.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    part[x] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(s) for x, s in part.items() if len(s) > 1}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()
