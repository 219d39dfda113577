"""Planner scores, strict joins, like pairs, bootstraps and BPE tokens against plain versions."""

import numpy as np
import pytest

from quern import catalog
from quern.functions import stats as S
from quern.functions import tokens as K
from quern.operators import curation as C
from quern.operators import lifecycle as L
from quern.operators import relational as R


def test_bpe_equals_the_library(spark, sf_dir):
    e = K.encoding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, " x"), (9004, "é漢字" * 500)], "doc_id long, text string"))
    rows = docs.select("doc_id", "text", K.token_count("text").alias("n"), K.encode("text").alias("ids"), K.decode(K.encode("text")).alias("back")).collect()
    for r in rows:
        assert r.ids == e.encode_ordinary(r.text or "") and r.n == len(r.ids) and r.back == (r.text or "")
    got = {}
    for r in K.bpe_chunks(docs, size=50, overlap=7).collect():
        got.setdefault(r.doc_id, {})[r.chunk_order_index] = (r.tokens, r.content)
    for r in rows:
        want = {i: (len(part), e.decode(part).strip(" ")) for i, part in enumerate(r.ids[a : a + 50] for a in range(0, len(r.ids), 43))}
        assert got.get(r.doc_id, {}) == want


def test_bpe_chunks_leave_in_bounded_batches(spark):
    import pyarrow as pa

    e = K.encoding()
    texts = ["word and word " * 2000, None, "", "é漢字 " * 900, *["a few more words"] * 3000]
    found = list(K.cut_texts(pa.array(range(len(texts))), pa.array(texts), 50, 7))
    assert len(found) > 3 and all(len(keys) <= K.BATCH_CHUNKS for keys, *_ in found)
    got = [(k, i, n, c) for keys, *rest in found for k, i, n, c in zip(keys.to_pylist(), *rest)]
    ids = [e.encode_ordinary(t or "") for t in texts]
    assert got == [(k, i, len(x[a : a + 50]), e.decode(x[a : a + 50])) for k, x in enumerate(ids) for i, a in enumerate(range(0, len(x), 43))]
    # one step from text to chunks: no column holds the ids of a batch of texts
    plan = K.bpe_chunks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_strict_join_and_sealing(spark):
    rows, labels = spark.createDataFrame([(1,), (2,)], "k int"), [(1, "a"), (2, "b")]
    make = lambda x: spark.createDataFrame(x, "k int, y string")
    assert sorted(tuple(r) for r in R.strict_join(rows, make(labels), "k").collect()) == labels
    for bad in (labels[:1], labels + [(2, "c")]):
        with pytest.raises(Exception, match="label"):
            R.strict_join(rows, make(bad), "k").collect()
    from pyspark.sql import functions as F

    assert R.after_sealing(rows, make(labels), "k", F.lit(True)).count() == 2
    with pytest.raises(Exception, match="sealed"):
        R.after_sealing(rows, make(labels), "k", F.col("k") == 1).collect()


def test_like_pairs_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(3)
    rows = [(k, "g%d" % (k % 2), [f"w{i}" for i in rng.choice(9, rng.integers(1, 7), replace=False)], "".join(rng.choice(list("abc"), 6))) for k in range(60)]
    got = {(r.left, r.right) for r in C.like_pairs(spark.createDataFrame(rows, "k int, g string, f array<string>, s string"), "k", "g", "f", "s", 0.6, 0.75).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and len({*a[2]} & {*b[2]}) / len({*a[2]} | {*b[2]}) >= 0.6 and SequenceMatcher(None, a[3], b[3]).ratio() >= 0.75:
                want.add((a[0], b[0]))
    assert got == want and want


def test_like_pairs_of_copies_are_a_star(spark):
    rows = [(k, "g", ["b", "a"] if k % 2 else ["a", "b"], "steps" if k < 40 else None) for k in range(60)] + [(60, "g", ["a", "b"], "step"), (61, "h", ["a", "b"], "steps"), (62, None, ["a"], "s"), (63, None, ["a"], "s"), (64, "g", [], "s")]
    got = sorted(tuple(r) for r in C.like_pairs(spark.createDataFrame(rows, "k int, g string, f array<string>, s string"), "k", "g", "f", "s", 0.6, 0.75).collect())
    want = [(0, k, 1.0, 1.0, "copy") for k in range(1, 40)] + [(40, k, 1.0, 1.0, "copy") for k in range(41, 60)] + [(0, 60, 1.0, 0.888888889, "like")]
    assert got == sorted(want)


def test_bootstrap_ends(spark):
    rows = [("x", k % 3 == 0, k % 2 == 0) for k in range(90)] + [("y", True, None), ("y", True, False)]
    df = spark.createDataFrame(rows, "g string, a boolean, b boolean")
    by = {e: {r.g: r for r in S.bootstrap_difference(df, "a", "b", "g", 4000, ends=e).collect()} for e in ("order", "interpolated", "floor")}
    for e, rs in by.items():
        assert rs["x"].n == 90 and rs["x"].difference == pytest.approx(15 / 90) and rs["x"].low <= rs["x"].difference <= rs["x"].high
        assert rs["y"].n == 2 and rs["y"].difference is None and rs["y"].low is None and rs["y"].high is None
        assert rs["x"].low == pytest.approx(by["order"]["x"].low, abs=0.02) and rs["x"].high == pytest.approx(by["order"]["x"].high, abs=0.02)


def test_clamped_fold_equals_the_walk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t) // 10, int(t), float(rng.choice([0.3, -0.4]))) for k in range(4) for t in rng.permutation(200)]
    got = {r.k: r.value for r in L.clamped_fold(spark.createDataFrame(rows, "k int, b int, t int, s double"), "k", "b", ["t"], "s", 0.0, -1.0, 1.0).collect()}
    for k in range(4):
        u = 0.0
        for _, _, _, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            u = max(-1.0, min(1.0, u + s))
        assert got[k] == pytest.approx(u)


def test_budget_and_counts_of_registered_bpe_queries(spark, sf_dir):
    e = K.encoding()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.QUERIES["bpe_budget_prefix"](spark, sf_dir).collect()
    assert rows and all(r.tokens == len(e.encode_ordinary(text[r.doc_id])) and r.running <= 4000 for r in rows)


def test_ranks_and_budgets_of_large_groups_equal_plain_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quern.operators import graph as G

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, None if k % 7 == 0 else "g%d" % (k % 3), int(rng.integers(0, 30)), int(rng.integers(0, 9))) for k in range(3000)], "k long, g string, a int, t int")
    d = F.md5(F.col("k").cast("string"))
    plain = df.select("k", F.row_number().over(Window.partitionBy("g").orderBy(d)).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    assert {tuple(r) for r in C.ranked(df, ["g"], C.hash_part(d), [d]).select("k", "_r", "_size").collect()} == {tuple(r) for r in plain.collect()}
    order = [F.col("a"), F.col("k")]
    both = [{tuple(r) for r in G.budget_prefix(df, "t", order, 400, ["g"], c).select("k", "running").collect()} for c in (None, "a")]
    assert both[0] == both[1] and both[0]


def test_contexts_by_real_tokens(spark, sf_dir):
    e = K.encoding()
    budgets = {("local", "relations"): 4000, ("global", "relations"): 2000, "entities": 1000, "sources": 2000}
    lines = {}
    for mode in ("local", "global"):
        rows = catalog.QUERIES[f"{mode}_context"](spark, sf_dir).collect()
        for section in ("relations", "entities", "sources"):
            own = sorted((r for r in rows if r.section == section), key=lambda r: r.running)
            lines[mode, section] = [r.line for r in own]
            total = 0
            for r in own:
                total += len(e.encode_ordinary(r.line))
                assert r.tokens == len(e.encode_ordinary(r.line)) and r.running == total
            assert own and total <= budgets.get((mode, section), budgets.get(section))
    got = {}
    for r in sorted(catalog.QUERIES["hybrid_context"](spark, sf_dir).collect(), key=lambda r: r.place):
        got.setdefault(r.section, []).append(r.line)
    assert got == {s: list(dict.fromkeys(lines["local", s] + lines["global", s])) for s in ("relations", "entities", "sources")}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 500)] + [("b", 7.0)] * 300 + [("b", 1.0)] * 3 + [("c", 2.5), (None, 1.0), (None, 4.0), ("a", None)]
    got = {r.g: r for r in S.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert [got[g][f"p{p}"] for p in (0, 10, 50, 95, 100)] == pytest.approx(np.percentile(v, [0, 10, 50, 95, 100]).tolist())
