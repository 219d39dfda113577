"""Every registered query with SQL equals it on the smallest tables; the others return rows."""

import math

import duckdb
import pytest

from quern import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want) and all(a == b for a, b in zip(got, want))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert rows


def test_stream_equals_batch_fold(spark, sf_dir):
    from quern.operators.lifecycle import usage_state
    from quern.plans.lifecycle import usage

    got = {r.key: (r.calls, r.successes, r.streak, round(r.utility, 9)) for r in catalog.QUERIES["stream_usage_state"](spark, sf_dir).collect()}
    want = {r.key: (r.calls, r.successes, r.streak, round(r.utility, 9)) for r in usage_state(usage(spark, sf_dir)).collect()}
    assert got == want


def test_entry_imports_without_the_llm_parts(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("quern.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name if name == "corpus_pipeline" else "quern.llm")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert entry.llm is None and set(entry.queries()) == set(catalog.QUERIES) and entry.oracle_sql()
    finally:
        sys.modules.pop("__spark_entry__", None)


def test_versions_are_aggregated_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    from quern.catalog import QUERIES
    from quern.operators import relational

    names = ("graph_upsert", "registry_overwrite", "bank_versions")
    want = {n: sorted(map(tuple, QUERIES[n](spark, sf_dir).collect())) for n in names}
    monkeypatch.setattr(relational, "TASK_ROWS", 20)
    for n in names:
        got = QUERIES[n](spark, sf_dir)
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sorted(map(tuple, got.collect())) == want[n] and max(sizes) < 60, n
