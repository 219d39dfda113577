import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, block, weights=(5, 2, 1), most=3):
    """(doc_id, source, size, source_size, target, taken) by walking every slot, from (doc_id, text, source)."""
    sizes, seen, docs = {}, {}, []
    for d, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        digest = hashlib.md5((text or "").encode()).hexdigest()
        seen[source, d, digest] = copy = seen.get((source, d, digest), 0) + 1
        docs.append((source, d, digest, copy, n))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if most * sizes[s] < share * weight[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
            open_.discard(s)
    taken = {}
    for s in names:
        need, stream = int(target[s] + 0.5), []
        for turn in range(most):
            key = lambda x: hashlib.md5(f"{turn}|{'' if x[1] is None else x[1]}|{x[2]}|{x[3]}".encode()).hexdigest()  # noqa: B023, E731
            for x in sorted((x for x in docs if x[0] == s), key=key):
                stream += [x] * x[4]
        for lo in range(0, need, block):  # block by block, as the slots do
            for x in stream[lo : min(lo + block, need)]:
                taken[x[:4]] = taken.get(x[:4], 0) + 1
    return sorted(((d, s, n, sizes[s], round(target[s], 6), taken.get((s, d, h, c), 0)) for s, d, h, c, n in docs), key=repr)


def result(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


ROWS = (
    [(i, "a b\tc " * (i % 7) + "x", f"s{i % 5}") for i in range(60)]
    + [(100 + i, "word " * 50, "hot") for i in range(80)]
    + [(1, None, None), (None, "one two three", None), (None, None, "s1"), (3, "", ""), (4, "tail of it", "z" * 3), (4, "tail of it", "zzz"), (4, "tail of it", "zzz"), (4, "other", "zzz"), (7, "long " * 30000, "s2"), (8, " wide", "\U0001f600"), (9, "tiny", "￮")]
)


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as taken", "3 as target", "4 as digest", "5 as _r", "6 as need", "7 as _source")
    for block in (64, 1024):
        got = result(mixing.taken(df, block))
        assert got == brute(ROWS, block)
        assert all(taken <= 3 * size for _, _, size, _, _, taken in got)
    assert got == result(mixing.taken(df.repartition(7)))


def test_order_of_the_mix(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    mix, _, goals = mixing.mixed(df, 64)
    goal = {r.source: r for r in goals.collect()}
    rows = mix.orderBy("slot", "round", "start").collect()
    slots = {}
    for r in rows:
        slots.setdefault((r.slot, r.source, r["rank"]), 0)
        slots[r.slot, r.source, r["rank"]] += r.words
    assert len({k[0] for k in slots}) == len(slots) == sum(g.blocks for g in goal.values())  # a slot has one block, a block one slot
    for s, g in goal.items():
        own = sorted((k, n) for k, n in slots.items() if k[1] == s)
        assert [k[2] for k, _ in own] == list(range(g.blocks))  # in the order of the slots
        assert [n for _, n in own[:-1]] == [64] * (len(own) - 1) and sum(n for _, n in own) == g.need
    # every stretch of the mix is near the weights
    n = sum(g.blocks for g in goal.values())
    order = [k[1] for k in sorted(slots)]
    for cut in (n // 4, n // 2, 3 * n // 4):
        for s, g in goal.items():
            assert abs(order[:cut].count(s) - g.blocks * cut / n) <= 5


def test_points_are_exact_and_spread(spark):
    got = [r.p for r in spark.range(1 << 12).select(mixing.point(F.col("id")).alias("p")).collect()]
    assert got == [k * mixing._GOLDEN % (1 << 40) for k in range(1 << 12)]
    far = 123456789012
    assert spark.range(1).select(mixing.point(F.lit(far)).alias("p")).first().p == far * mixing._GOLDEN % (1 << 40)
    cells = [p >> 32 for p in got]
    assert max(cells.count(c) for c in set(cells)) <= 18 and len(set(cells)) == 256


def test_targets_stop_and_reshare(spark):
    sizes = [(f"s{i:02}", n) for i, n in enumerate([1, 2, 3, 1000, 1, 1, 10, 0, 5])]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert abs(sum(got.values()) - 1023) < 1e-9
    assert got["s00"] == 3.0 and got["s07"] == 0.0 and all(got[s] <= 3 * n for s, n in sizes)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(none).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert result(mixing.taken(blank)) == [(1, "a", 0, 0, 0.0, 0), (2, "b", 0, 0, 0.0, 0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_sql(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts)
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.taken(docs).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted((a, b, c, round(t, 6), n) for a, b, c, t, n in con.execute(mixing.TAKEN_SQL).fetchall())
