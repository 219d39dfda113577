import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import contexts, vectors


@pytest.mark.parametrize("floor,k", [(0.2, 5), (None, 3), (0.95, 50)])
def test_nearest_equals_all_cosines(spark, monkeypatch, floor, k):
    monkeypatch.setattr(vectors, "ROWS", 100)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(500, 24)), 1))]
    rows += [(1000 + i, rows[3][1]) for i in range(8)] + [(2000, [0.0] * 24), (2001, None), (2002, []), (2003, [1.0, None]), (2004, [1.0, 2.0]), (2005, [math.nan] * 24)]
    asked = rows[:40] + [(1000, rows[3][1]), (2000, [0.0] * 24), (2001, None), (2004, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v)) if v and None not in v else 0.0
    want = set()
    for i, a in asked:
        near = []
        for j, b in rows:
            if a and b and len(a) == len(b) and size(a) > 0 and size(b) > 0:
                s = round(float(np.dot(a, b)) / (size(a) * size(b)), 6)
                if floor is None or s >= floor:
                    near.append((-s, j))
        want |= {(i, j, -s) for s, j in sorted(near)[:k]}
    got = {(r.query_id, r.id, r.similarity) for r in vectors.nearest(q, df, k, floor).collect()}
    assert {(i, j, round(s, 5)) for i, j, s in got} == {(i, j, round(s, 5)) for i, j, s in want}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_tasks_hold_a_part_and_a_block(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "ASKS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 8)), 1))] + [(400, [1.0, None]), (401, [1.0] * 3)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    found = vectors.nearest(df.toDF("query_id", "query_vector"), df, 4)
    v = np.array([x for _, x in rows[:300]], np.float32 if kind == "float" else np.float64).astype(np.float64)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    s = np.round(v @ v.T, 6)
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -s[i]))[:4] if s[i, j] >= 0.2} | {(401, 401)}
    assert {(r.query_id, r.id) for r in found.collect()} == want
    assert "hashpartitioning(part#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", block#" in plan


def test_ranks_are_joined_at_hits_only(spark):
    edges = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 2.0), ("c", "z", 9.0), ("x", "x", 1.0)], "src string, tgt string, weight double")
    g = contexts.Graph(edges, edges.selectExpr("src as id", "src as name"), edges.selectExpr("1L as chunk", "src", "tgt", "weight as quantity"))
    hits = spark.createDataFrame([(7, "x", 0.9), (8, "a", 0.5)], "query_id long, id string, similarity double")
    assert g.edges.columns == ["src", "tgt", "weight"]
    assert sorted(tuple(r) for r in g.near(hits, "local").collect()) == [("a", "x", 3.0, 5), ("b", "x", 2.0, 5), ("x", "x", 1.0, 8)]
    assert sorted(tuple(r) for r in g.near(hits, "global").collect()) == [("a", "x", 3.0, 5), ("x", "x", 1.0, 8)]


def test_sections_of_two_queries(spark):
    edges = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 2.0), ("c", "z", 9.0)], "src string, tgt string, weight double")
    nodes = spark.createDataFrame([("a", "one"), ("b", "two"), ("x", "end")], "id string, name string")
    mentions = spark.createDataFrame([(1, "a", "x", 5.0), (1, "b", "x", 1.0), (2, "a", "y", 2.0)], "chunk long, src string, tgt string, quantity double")
    hits = spark.createDataFrame([(7, "a", 0.9), (7, "x", 0.8), (8, "b", 0.5), (8, "nowhere", 0.4)], "query_id long, id string, similarity double")
    g = contexts.Graph(edges, nodes, mentions)
    got = {}
    for r in g.sections(hits, "local", (100, 100, 100)).orderBy("running").collect():
        got.setdefault((r.query_id, r.section), []).append((r.line, r.running))
    assert got[7, "relations"] == [("a,x,3.0,4", 5), ("b,x,2.0,3", 10), ("a,y,1.0,3", 15)]
    assert got[7, "entities"] == [("a,one,2", 3), ("x,end,2", 6)] and got[8, "entities"] == [("b,two,1", 3)]
    assert got[7, "sources"] == [("1,6.0", 3), ("2,2.0", 6)] and got[8, "sources"] == [("1,1.0", 3)]
    cut = g.sections(hits, "local", (9, 3, 3)).filter("query_id = 7").collect()
    assert sorted(r.line for r in cut) == ["1,5.0", "a,one,2", "a,x,3.0,4"]
    assert g.sections(hits.filter(F.lit(False)), "global", (9, 9, 9)).count() == 0


def test_all_queries_against_all_rows_need_no_ranking(spark):
    """Before, each part returned its best of every query, and these were shuffled and ranked."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(9000, 6)), 1)
    v[5000:] = v[:4000]  # ties by id, far beyond the first rows
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3).cache()
    found = vectors.nearest(df.toDF("query_id", "query_vector"), df, 4, 0.9)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.filter("query_id % 90 = 7").collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    v = v.astype(np.float32).astype(np.float64)
    size = np.sqrt((v * v).sum(axis=1))
    for i in range(7, 9000, 90):
        s = np.round(v @ v[i] / np.maximum(size * size[i], 1e-300), 6)
        want = [int(j) for j in np.lexsort((np.arange(9000), -s))[:4] if s[j] >= 0.9] if size[i] else []
        assert [j for _, j in sorted(got.get(i, []))] == want


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_places_within_the_budget(spark, batch):
    rows = [(q, [(7 * q + 5 * h + 3 * e) % 50 for e in range(h + 1)]) for q in range(12) for h in range(q % 5)] + [(40, []), (41, [3]), (41, [3, 9])]
    count = lambda p: p % 4 + 1
    df = spark.createDataFrame([(q, p, [count(x) for x in p]) for q, p in rows], "query_id long, places array<long>, counts array<long>")
    want = set()
    for q in {q for q, _ in rows}:
        running = 0
        for p in sorted({x for o, ps in rows if o == q for x in ps}):
            running += count(p)
            if running <= 9:
                want.add((q, p, count(p), running))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [tuple(r) for r in contexts.fitting_places(df, 9, 1).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_edges_of_mentions_only_at_hits(spark, monkeypatch, sent):
    """Before, the edges of all mentions were added up and stored; ids may be numbers now."""
    monkeypatch.setattr(contexts, "SENT", sent)
    mentions = [(1, 2, 3, 5.0), (2, 2, 3, 1.0), (2, 2, 5, 2.0), (3, 4, 3, 4.0), (4, 6, 7, 9.0), (4, 6, 3, 1.0), (5, 3, 3, 8.0)]
    m = spark.createDataFrame(mentions, "chunk long, src long, tgt long, quantity double")
    nodes = spark.createDataFrame([(2, "one"), (3, "end"), (6, "off")], "id long, name string")
    hits = spark.createDataFrame([(8, 2, 0.9), (9, 3, 0.5), (9, 2, 0.4)], "query_id long, id long, similarity double")
    name = lambda c: F.concat(F.lit("n"), F.col(c))
    g = contexts.Graph(None, nodes, m, name)
    named = m.select("chunk", name("src").alias("src"), name("tgt").alias("tgt"), "quantity")
    edges = named.groupBy("src", "tgt").agg(F.sum("quantity").alias("weight"))
    old = contexts.Graph(edges, nodes.select(name("id").alias("id"), "name"), named)
    other = hits.select("query_id", name("id").alias("id"), "similarity")
    assert sorted(tuple(r) for r in g.near(hits, "global").collect()) == [(2, 3, 6.0, 7), (2, 5, 2.0, 3), (3, 3, 8.0, 10)]
    for mode in ("local", "global"):
        got = sorted(tuple(r) for r in g.sections(hits, mode, (14, 9, 6)).collect())
        assert got and got == sorted(tuple(r) for r in old.sections(other, mode, (14, 9, 6)).collect())
    assert sorted(map(tuple, g.both(hits).collect())) == sorted(map(tuple, old.both(other).collect()))
    assert {r.line for r in g.sections(hits, "local", (99, 99, 99)).filter("section = 'relations' and query_id = 9").collect()} == {"n2,n3,6.0,7", "n2,n5,2.0,3", "n3,n3,8.0,10", "n4,n3,4.0,6", "n6,n3,1.0,7"}


def test_vectors_of_one_query_share_its_places(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.1, 0.8]), (4, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vectors.nearest(df.toDF("query_id", "query_vector").filter("query_id < 3"), df, 3)
    got = sorted((r.query_id, -r.similarity, r.id) for r in found.collect())
    assert [(q, i) for q, _, i in got] == [(1, 1), (1, 1), (1, 4), (2, 2), (2, 1), (2, 3)]


def test_repeated_hits_and_nodes_count_as_often_as_sql_joins_them(spark):
    m = spark.createDataFrame([(1, 2, 3, 5.0), (2, 2, 5, 1.0)], "chunk long, src long, tgt long, quantity double")
    nodes = spark.createDataFrame([(2, "one"), (2, "one")], "id long, name string")
    hits = spark.createDataFrame([(8, 2, 0.9), (8, 2, 0.9)], "query_id long, id long, similarity double")
    g = contexts.Graph(None, nodes, m)
    lines = lambda mode: sorted((r.section, r.line, r.running) for r in g.sections(hits, mode, (99, 99, 99)).collect())
    assert [x for x in lines("global") if x[0] == "relations"] == [("relations", "2,3,5.0,3", 5), ("relations", "2,3,5.0,3", 10), ("relations", "2,5,1.0,3", 15), ("relations", "2,5,1.0,3", 20)]
    assert [x for x in lines("global") if x[0] != "relations"] == [("entities", "2,one,2", 3), ("entities", "2,one,2", 6), ("sources", "1,10.0", 3), ("sources", "2,2.0", 6)]
    assert [x for x in lines("local") if x[0] == "relations"] == [("relations", "2,3,5.0,3", 5), ("relations", "2,5,1.0,3", 10)]


def test_merged_contexts_are_not_sorted_to_be_grouped(spark):
    m = spark.createDataFrame([(1, 2, 3, 5.0), (2, 2, 5, 1.0)], "chunk long, src long, tgt long, quantity double")
    hits = spark.createDataFrame([(8, 2, 0.9), (9, 2, 0.9)], "query_id long, id long, similarity double")
    g = contexts.Graph(None, spark.createDataFrame([(2, "one")], "id long, name string"), m)
    merged = g.both(hits)
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r.section, r.place, r.line) for r in merged.collect())
    assert got[:5] == [(8, "entities", 1, "2,one,2"), (8, "relations", 1, "2,3,5.0,3"), (8, "relations", 2, "2,5,1.0,3"), (8, "sources", 1, "1,5.0"), (8, "sources", 2, "2,1.0")]
