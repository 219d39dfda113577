import math

import duckdb
import numpy as np
import pytest

from quern.llm import vectors, whitening


def exact(rows):
    """{vec_id: (n, deviation)} and numpy's whitened rows, from (vec_id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    x = [tuple(math.floor(64 * c) + 1000000 for c in v) for _, v in kept]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    far = sorted(((i, n, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for (i, _), v in zip(kept, x)), key=repr)
    u = np.array(fit, float)
    c = u - u.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / n)
    return kept, far, (np.array(x, float) - u.mean(axis=0)) @ q[:, ::-1], e[::-1]


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    shape = rng.normal(size=(6, 6))
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) @ shape + 2)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(2001, None), (2002, []), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [math.nan] * 6), (2005, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0]), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as n", "'k' as _vector", "3 as component")
    kept, far, white, e = exact(rows)
    for parts in (1, 5):
        got = whitening.whitened(df.repartition(parts)).collect()
        assert sorted({(r.vec_id, r.n, r.deviation) for r in got}, key=repr) == sorted(set(far), key=repr)
        assert len(got) == 6 * len(kept) and {r.component for r in got} == set(range(1, 7))
        for (i, _), w in zip(kept, white):
            own = {r.component: r for r in got if r.vec_id == i}
            for k, r in own.items():
                assert abs(abs(r.whitened) - abs(w[k - 1]) / math.sqrt(e[k - 1])) < 1e-8
                assert abs(r.explained / (e[k - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_components_stop_at_the_rank(spark):
    rows = [(i, [float(i % 5), float(2 * (i % 5)), 1.0, float(i % 3)]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 80 and max(r.identity_error for r in got) < 1e-9
    one = [(i, [1.0, 2.0]) for i in range(9)]
    assert whitening.whitened(spark.createDataFrame(one, "vec_id long, embedding array<double>")).collect() == []


def test_empty_table_and_errors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = whitening.whitened(none)
    assert out.collect() == [] and out.columns == [f.split()[0] for f in whitening._FIELDS.split(", ")]
    assert whitening.whitened(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(Exception, match="62 bits"):
        whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


def test_packing_keeps_every_width():
    rng = np.random.default_rng(5)
    whole = np.concatenate([rng.integers(-(1 << b), 1 << b, (9, 5)) for b in (3, 7, 8, 15, 16, 31, 32, 60)] + [np.array([[-128, 127, 0, 0, 0], [-129, 0, 0, 0, 0], [128, 0, 0, 0, 0]])])
    rng.shuffle(whole)
    import pyarrow as pa

    packed = vectors.pack(whole)
    assert (vectors.unpack(pa.array(packed, pa.binary()), 5) == whole).all()
    assert (vectors.unpack(pa.array(packed, pa.binary()).slice(4, 30), 5) == whole[4:34]).all()
    assert {len(p) for p in packed} == {5, 10, 20, 40}


def test_deviation_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = got.collect()
    assert sorted({(r.vec_id, r.n, r.deviation) for r in rows}) == sorted(con.execute(whitening.DEVIATION_SQL).fetchall())
    assert len(rows) == 16 * len({r.vec_id for r in rows}) and max(r.identity_error for r in rows) < 1e-9
