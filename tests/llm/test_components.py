import random

from pyspark.sql import functions as F

from lodestrata.llm import components
from lodestrata.llm.components import connected_components
from lodestrata.llm.ngram_jaccard import keep_one_of_similar


def brute(edges):
    least = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            least.setdefault(u, u)
            least.setdefault(v, v)
    again = True
    while again:
        again = False
        for u, v in edges:
            if u in least and v in least and least[u] != least[v]:
                least[u] = least[v] = min(least[u], least[v])
                again = True
    return sorted(least.items())


def plans(spark, after=-1):
    """(number, plan) of the queries after one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    found = [(done.apply(i).executionId(), done.apply(i).physicalPlanDescription()) for i in range(done.size())]
    return sorted(x for x in found if x[0] > after)


def test_components_whatever_a_piece_holds(spark, monkeypatch):
    rnd = random.Random(3)
    chain = rnd.sample(range(-400, 400), 300)
    edges = list(zip(chain, chain[1:])) + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(160)]
    edges += [(2000, x) for x in range(2001, 2060)] + [(2**62, -(2**62)), (5000, 5000), (None, 1), (2, None)]
    rnd.shuffle(edges)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for piece in (7, 500_000):
        monkeypatch.setattr(components, "PIECE_EDGES", piece)
        assert sorted(map(tuple, connected_components(frame).collect())) == brute(edges)
    assert connected_components(frame.limit(0)).isEmpty()


def test_a_long_chain_takes_few_queries(spark):
    chain = random.Random(8).sample(range(3000), 3000)
    frame = spark.createDataFrame(list(zip(chain, chain[1:])), "u long, v long")
    last = max([i for i, _ in plans(spark)], default=-1)
    assert connected_components(frame).select("component").distinct().collect() == [(0,)]
    assert len(plans(spark, last)) <= 5


def test_no_table_of_documents_is_broadcast(spark):
    """The driver gets no broadcast that grows with the documents, however small they are."""
    text = F.concat(F.expr("concat_ws(' ', transform(sequence(1, 40), i -> concat('w', id div 3, 'x', i)))"), F.lit(" t"), F.col("id").cast("string"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text")).localCheckpoint()
    last = max([i for i, _ in plans(spark)], default=-1)
    assert sorted(r["doc_id"] for r in keep_one_of_similar(docs).collect()) == list(range(0, 60, 3))
    seen = plans(spark, last)
    assert len(seen) > 5 and sum("SortMergeJoin" in p for _, p in seen) > 5
    # of wide clusters there may be one, a row each
    assert [p for _, p in seen if "BroadcastHashJoin" in p and "_salt" not in p] == []
