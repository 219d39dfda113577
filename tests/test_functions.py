"""Golden cases of text, statistics, rules, sources and graph operators."""

import pytest
from pyspark.sql import functions as F

from quern.functions import scoring as M
from quern.functions import stats as S
from quern.functions import text as N
from quern.operators import curation as C
from quern.operators import graph as G
from quern.operators.lifecycle import usage_state
from quern.sources import files


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "f, text, want",
    [
        (N.qa_normalize, "The  Cat, a DOG!", "cat dog"),
        (N.boxed_first, r"so \boxed{ 4 } and \boxed{5}", "4"),
        (N.boxed_balanced, r"\boxed{1} then \boxed{\frac{1}{2}} \boxed{open", r"\frac{1}{2}"),
        (N.boxed_nested_last, r"\boxed{\sqrt{2}} and \boxed{\frac{3}{4}}", r"\frac{3}{4}"),
        (N.boxed_nested_last, "One thing. The end", "The end"),
        (N.hash_answer, "work\n#### 1,234\nmore", "1234"),
        (N.last_number, "from 3 to 1,250.5 units", 1250.5),
        (N.last_number, "none", None),
        (N.answer_cascade, "The answer is 1,000.\n", "1000"),
        (N.answer_cascade, "a 12 b 7", "7"),
        (N.answer_cascade, "first\n last ", "last"),
        (N.normalize_answer, "$3.0", "3"),
        (N.normalize_answer, "230 miles", "230"),
        (N.normalize_answer, r"\dfrac{1}{2}", r"\frac{1}{2}"),
        (N.rational, "1,234.50", "2469/2"),
        (N.rational, r"\frac{2}{-4}", "-1/2"),
        (N.rational, "x + 1", "x+1"),
        (N.option_label, "(B)", "b"),
        (N.option_label, "C. ", "c"),
        (N.parse_number, r"12\%", 0.12),
        (N.parse_number, "1,200", 1200.0),
        (N.digit_mask, "A  12 and 3.5", "a # and #"),
        (N.token_estimate, "", 0),
        (N.token_estimate, "é", 1),
        (N.word_count, "  ", 0),
        (N.unescape_html, "&lt;b&gt; &eacute;", "<b> é"),
        (N.nfkc, "ﬁ  X", "fi x"),
        (N.code_fence, "a\n```python\nx = 1\n```\nb", "x = 1"),
        (N.json_slice, 'pre {"a": {"b": 1}} post', '{"a": {"b": 1}}'),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f("t"), t=text) == want


def test_ratios(spark):
    assert one(spark, N.sequence_ratio("a", "b"), a="abcd", b="bcde") == pytest.approx(0.75)
    assert one(spark, N.indel_ratio("a", "b"), a="kitten", b="sitting") == pytest.approx(8 / 13)
    assert one(spark, N.indel_ratio("a", "b"), a="", b="") == 1.0
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(N.jaccard("a", "b").alias("x")).collect()] == [pytest.approx(1 / 3), 0.0]


def test_chunks_keep_a_tail_inside_the_last_one(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, "one")], "doc_id long, text string")
    rows = [(r.doc_id, r.chunk_order_index, r.tokens) for r in N.chunks(df, 4, 1).orderBy("doc_id", "chunk_order_index").collect()]
    assert rows == [(1, 0, 4), (1, 1, 4), (1, 2, 4), (1, 3, 1), (3, 0, 1)]


def test_mcnemar_and_intervals(spark):
    df = spark.createDataFrame([(10, 0), (1, 1), (0, 0)], "b long, c long")
    assert [r.x for r in df.select(S.mcnemar_exact("b", "c").alias("x")).collect()] == [pytest.approx(2 / 1024), 1.0, 1.0]
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k long, n long")
    got = df.select(S.clopper_pearson_low("k", "n").alias("a"), S.clopper_pearson_high("k", "n").alias("b")).collect()
    assert (got[0].a, round(got[0].b, 4)) == (0.0, 0.3085) and (round(got[1].a, 4), got[1].b) == (0.6915, 1.0)
    assert round(got[2].a, 4) == 0.1871 and round(got[2].b, 4) == 0.8129 and got[3].a is None
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    rows = df.select(lo.alias("a"), hi.alias("b")).collect()
    assert rows[0].a == 0.0 and rows[3].a is None and round(rows[2].a, 4) == 0.2366
    pairs = spark.createDataFrame([("x", i % 2 == 0, True) for i in range(20)] + [("y", True, True)] * 5, "g string, a boolean, b boolean")
    boot = {r.g: r for r in S.bootstrap_difference(pairs, "a", "b", "g", 2000).collect()}
    assert boot["x"].difference == 0.5 and 0.2 < boot["x"].low < 0.5 < boot["x"].high < 0.8 and (boot["y"].low, boot["y"].high) == (0.0, 0.0)


def test_rules(spark):
    facts = {"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}
    value = lambda tree: spark.range(1).select(M.trigger(tree, facts).alias("x")).first().x
    assert value({"all_of": ["a", "b"]}) is None and value({"all_of": ["b", "c"]}) is False
    assert value({"any_of": ["a", "b"]}) is True and value({"not": "b"}) is None
    assert value({"all_of": [{"optional": "c"}, {"guard": "c"}]}) is True and value({"all_of": []}) is True and value({"any_of": []}) is False
    status = lambda s, u, f, a: spark.range(1).select(M.skill_status(F.lit(s), F.lit(u), F.lit(f), F.lit(a)).alias("x")).first().x
    assert [status("draft", 0.0, 9, 9), status("suppressed", 0.9, 0, 2), status("suppressed", 0.9, 0, 1), status("active", 0.34, 0, 0), status("active", 0.9, 2, 0)] == ["draft", "pruned", "active", "suppressed", "suppressed"]


def test_usage_state_rounding(spark):
    df = spark.createDataFrame([("k", 1, 1, True), ("k", 2, 2, False), ("k", 3, 3, False)], "key string, ts long, seq long, ok boolean")
    r = usage_state(df, digits=4).first()
    assert (r.calls, r.successes, r.streak) == (3, 1, 2) and r.utility == pytest.approx(0.4792, abs=1e-9)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "src string, tgt string")
    assert {r.id: r.degree for r in G.degrees(e).collect()} == {"a": 1, "b": 2, "c": 1, "x": 1, "y": 1, "z": 2}
    comps = {r.id: r.component for r in G.connected_components(e).collect()}
    assert comps == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    chain = spark.range(200).selectExpr("id src", "id + 1 tgt")
    assert {r.component for r in G.connected_components(chain).collect()} == {0}
    assert {r.component for r in G.connected_components(e.union(spark.createDataFrame([(None, "q"), ("z", None)], "src string, tgt string"))).filter("id in ('q', 'z')").collect()} == {"z"}
    m = spark.createDataFrame([("N", "t2", "d1", "c1", 1), ("N", "t1", "d2", "c1", 2)], "name string, kind string, description string, source_id string, seq int")
    r = G.merge_entities(m).first()
    assert (r.kind, r.description, r.source_id) == ("t2", "d1<SEP>d2", "c1")


def test_components_of_random_graphs_from_small_forests(spark, monkeypatch):
    import random

    monkeypatch.setattr(G, "FOREST", 40)
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 - i, 999 - i) for i in range(90)]
    root = {x: x for e in edges for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    for kind, same in (("long", int), ("string", str)):
        df = spark.createDataFrame([(same(a), same(b)) for a, b in edges * 2], f"src {kind}, tgt {kind}")
        want = {}
        for x in root:
            want.setdefault(top(x), []).append(same(x))
        got = {(x.id, x.component) for x in G.connected_components(df).collect()}
        assert got == {(x, min(xs)) for xs in want.values() for x in xs}


def test_components_forest_has_a_row_a_node(spark):
    dense = spark.range(5000).selectExpr("concat('P', id % 50) src", "concat('S', id % 41) tgt").coalesce(1)
    assert G.forest(dense).count() == 91 and G.forest(dense).filter("tgt <> 'P0'").count() == 0


def test_record_parser(spark):
    t = N.FIELD_DELIMITER
    raw = f'("entity"{t}ann{t}person{t}tall)##("relationship"{t}ann{t}bob{t}knows{t}friend{t}2.5)##("relationship"{t}a{t}b{t}c{t}d{t}many)##("entity"{t}{t}x{t}y)##junk<END>'
    rows = N.parse_records(spark.createDataFrame([(raw,)], "raw string"), "raw").collect()
    assert [(r.record, r.name, r.tgt, r.weight) for r in rows] == [("entity", "ANN", None, None), ("relationship", "ANN", "BOB", 2.5), ("relationship", "A", "B", 1.0)]


def test_largest_remainder_and_near_duplicates(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert {r.k: r.quota for r in C.largest_remainder(s, "k", "n", 100).collect()} == {"a": 34, "b": 33, "c": 33}
    base = "a long enough sentence about the number 12 and other things"
    d = spark.createDataFrame([(1, base), (2, base.replace("12", "99")), (3, base + "!"), (4, "something else altogether here")], "id long, text string")
    assert [(r.left, r.right) for r in C.near_duplicate_pairs(d, "id", "text", 0.9).collect()] == [(1, 3)]


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    assert files.read_json(spark, f"{p}/none.json", "a int") is None
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, f"{p}/a.jsonl", "a int").orderBy("a").collect()] == [1, 2]
    assert [r.a for r in files.positional_subset(files.read_jsonl(spark, f"{p}/a.jsonl", "a int"), "a", [1, 7]).collect()] == [2]
    (tmp_path / "m.txt").write_text("11 # first\n\n# none\n12\n")
    (tmp_path / "m.json").write_text('{"task_ids": ["a", "b"]}')
    (tmp_path / "l.json").write_text('["c"]')
    ids = lambda f: [r.task_id for r in files.read_manifest(spark, f"{p}/{f}").orderBy("position").collect()]
    assert ids("m.txt") == ["11", "12"] and ids("m.json") == ["a", "b"] and ids("l.json") == ["c"]
    (tmp_path / "g.jsonl").write_text('{"question": "q", "answer": "so\\n#### 1,200"}\n')
    r = files.load_tasks(spark, "gsm8k", f"{p}/g.jsonl", limit=1).first()
    assert r.answer == "1200" and r.prompt == "q" and r.task_id.startswith("gsm8k/")
    with pytest.raises(ValueError):
        files.load_tasks(spark, "other", p)
    for n in (1, 2):
        (tmp_path / f"round_{n}").mkdir()
        (tmp_path / f"round_{n}" / "experience.json").write_text('{"score": %d}' % n)
        (tmp_path / f"run{n}").mkdir()
        (tmp_path / f"run{n}" / "episodes.jsonl").write_text('{"score": %d}\n' % n)
    assert sorted((r.round, r.score) for r in files.read_rounds(spark, p, "score int").collect()) == [(1, 1), (2, 2)]
    assert sorted((r.run, r.score) for r in files.read_runs(spark, p, "score int").collect()) == [("run1", 1), ("run2", 2)]
    a, b = spark.createDataFrame([(1, [1, 2])], "x int, l array<int>"), spark.createDataFrame([(2,)], "y int")
    u = files.union_of_columns([a, b])
    assert u.columns == ["l", "x", "y"] and u.count() == 2
    files.write_csv(a, f"{p}/csv")
    assert spark.read.csv(f"{p}/csv", header=True, escape='"').first().l == "[1,2]"
    assert files.export_jsonl(a, f"{p}/out").first().rows == 1
    assert files.markdown_table(b) == "| y |\n| --- |\n| 2 |"
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(5), limit=3)
    s = files.results_summary(spark.createDataFrame([(1.0, 2.0), (0.0, 6.0)], "score double, cost double")).first()
    assert (s.average_score, s.total_cost, s.average_cost) == (0.5, 6.0, 3.0)
    assert one(spark, files.decode_test_cases("t")[0]["input"], t='[{"input": "1", "output": "2", "testtype": "stdin"}]') == "1"


def test_graphml_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("b", "T", "d & e"), ("a", "T", "x")], "id string, entity_type string, description string")
    e = spark.createDataFrame([("a", "b", 2.5)], "src string, tgt string, weight double")
    files.write_graphml(n, e, str(tmp_path / "g"))
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g"))
    assert sorted((r.id, r.entity_type) for r in nodes.collect()) == [("a", "T"), ("b", "T")]
    assert [(r.src, r.tgt, r.weight) for r in edges.collect()] == [("a", "b", 2.5)]


def test_exact_answers(spark):
    from quern.functions import exact as X

    same = [("\\frac{1}{2}", "2/4"), ("3", "6/2"), ("2x + 1", "1+2x"), ("x - 3", "-3 + x"), ("-x+2", "2-x"), ("[0, 2)", "[0,2)"), ("3+-2x", "3 - 2x"), ("\\frac{-3}{6}", "-1/2")]
    other = [("1/2", "1/3"), ("2x+1", "2x+2"), ("[0,2)", "[0,2]"), ("[0,2)", "2/3"), ("2x", "2")]
    open_ = [("1/0", "1"), ("sin x", "1"), ("", "1"), ("2xx", "2x"), (None, "1"), ("x^2", "x")]
    rows = [(a, b, True) for a, b in same] + [(a, b, False) for a, b in other] + [(a, b, None) for a, b in open_]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("a", "b", "want", X.same_value("a", "b").alias("got"), X.same_value("b", "a").alias("back")).collect()
    assert [r for r in got if r.got is not r.want or r.back is not r.want] == []
