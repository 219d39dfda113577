import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import negatives
from quern.llm import queries as llm


def brute(rows):
    """The result by the contract's words, from (vec_id, label, vector) with one length; repeated rows are one."""
    kept = set()
    for i, label, v in rows:
        if label is None or v is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    first = lambda p: (-p[0], p[1][0] is None, p[1][0] or 0)
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in kept if b != a]
        for ps, p in sorted((s for s in scored if s[1][1] == a[1]), key=first)[:5]:
            fit = sorted((s for s in scored if s[1][1] != a[1] and 80 * ps <= 100 * s[0] <= 100 * ps), key=first)[:5]
            out += [(a[0], p[0], r, n[0], ps, ns) for r, (ns, n) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


def rows_of(seed, n=700, clusters=12, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, 8))
    return [(i, int(rng.integers(0, 4)) if i % 3 else 2, [float(x) * scale for x in np.round(middle[rng.integers(clusters)] + rng.normal(size=8) * 0.1, 2)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 300.0, 3e5])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "ROWS", 150)
    rows = rows_of(1, scale=scale)
    rows += [(800, 2, [0.0] * 8), (900, 77, [1.0] * 8), (1000, 1, [-9.0 * scale] * 8), (100, 3, rows[100][2]), rows[200], rows[200], (200, 0, rows[5][2])]  # lone label, ids of several rows, a row twice
    rows += [(2001 + k, 2, list(rows[300][2])) for k in range(9)]  # ties
    rows += [(3000, None, [1.0] * 8), (3100, 1, None), (3200, 1, [None] + [1.0] * 7), (3300, 1, [math.nan] * 8), (3400, 1, [math.inf] * 8), (3500, 1, [1.0]), (None, 1, [3.0] * 8), (None, 2, [3.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as key", "2 as part", "3 as x", "4 as pivots", "5 as _vector", "6 as is_anchor")
    got = result(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == brute(rows) and len(got) > 50


def test_brackets_hold_and_drop():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16)) * 400
    x = np.floor(middle[rng.integers(20, size=900)] + rng.normal(size=(900, 16)) * 10).astype(np.int64)
    longest = int(negatives.squares(x).max())
    piv = negatives.spread(x[:200], longest)
    d, a = negatives.row_distances(x, piv, longest), negatives.anchor_distances(x[:50], piv, longest)
    lo, hi = negatives.bracket(a, negatives.squares(x[:50]), d, d, longest)
    s = x[:50] @ x.T
    assert (lo <= s).all() and (s <= hi).all()
    top = np.sort(s, axis=1)[:, -5, None]
    assert (hi >= top).mean() < 0.5  # vectors with structure are dropped by their brackets alone


def test_scores_are_exact_at_every_length():
    rng = np.random.default_rng(4)
    for bits in (8, 18, 28):
        x = rng.integers(-(1 << bits), 1 << bits, (40, 8))
        want = np.array([[sum(int(p) * int(q) for p, q in zip(a, b)) for b in x] for a in x])
        assert (negatives.exact_products(x, x, int(negatives.squares(x).max())) == want).all()
    with pytest.raises(OverflowError):
        negatives.squares(np.full((1, 4), 1 << 31, np.int64))


def test_empty_tables(spark):
    shape = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], shape), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(100, None, [1.0])], shape), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], shape), F.col("vec_id") % 100 == 0).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(negatives.NEGATIVES_SQL).fetchall(), key=repr)
    assert result(llm.op13_hard_negatives(spark, sf_dir)) == want and want
