"""Sources and sinks: replacement, packed cases, stores by key, GraphML files, loaders."""

import base64
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from quern.sources import files


def test_replacement_keeps_what_readers_read(spark, tmp_path):
    path = f"{tmp_path}/store"
    for rows in ([(1, "a")], [(1, "a"), (2, "b")]):
        files.write_json(spark.createDataFrame(rows, "k int, v string"), path)
        assert sorted((r.k, r.v) for r in files.read_jsonl(spark, path, "k int, v string").collect()) == rows
    files.write_json(files.read_jsonl(spark, path, "k int, v string").filter("k = 2"), path)  # reads what it replaces
    assert [r.k for r in files.read_jsonl(spark, path, "k int, v string").collect()] == [2] and os.listdir(tmp_path) == ["store"]


def test_export_digest_is_of_the_content(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id % 3 as string) v")
    a, b = files.export_jsonl(df.repartition(1), f"{tmp_path}/a").first(), files.export_jsonl(df.repartition(7), f"{tmp_path}/b").first()
    other = files.export_jsonl(df.withColumn("v", F.when(F.col("id") == 5, "x").otherwise(F.col("v"))), f"{tmp_path}/c").first()
    assert a == b and a.rows == 100 and a.digest != other.digest


def test_packed_cases(spark):
    cases = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    packed = base64.b64encode(zlib.compress(cases.encode())).decode()
    pickled = base64.b64encode(zlib.compress(b"\x80\x04\x95abc")).decode()
    rows = spark.createDataFrame([(0, cases), (1, packed), (2, pickled), (3, "no case"), (4, None)], "k int, raw string")
    got = {r.k: r.c for r in rows.select("k", files.decode_test_cases("raw").alias("c")).collect()}
    assert got[0] == got[1] and got[0][0].output == "2" and got[2] is got[3] is got[4] is None


def test_store_by_key_and_graphml(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2), ("r2", 3)], "run string, v int")
    files.save_partitioned(df, f"{tmp_path}/s", "run")
    assert sorted(map(tuple, files.load_partitioned(spark, f"{tmp_path}/s", "v int", "run").select("run", "v").collect())) == [("r1", 1), ("r2", 2), ("r2", 3)]
    assert sorted(r.v for r in files.load_partitioned(spark, f"{tmp_path}/s", "v int", "run", "r2").collect()) == [2, 3]
    n = spark.createDataFrame([("B", "t", "x & y"), ("A", "u", '"q"')], "id string, entity_type string, description string")
    e = spark.createDataFrame([("A", "B", 2.0)], "src string, tgt string, weight double")
    files.write_graphml(n, e, f"{tmp_path}/g")
    nodes, edges = files.read_graphml(spark, f"{tmp_path}/g")
    assert sorted((r.id, r.entity_type, r.description) for r in nodes.collect()) == [("A", "u", "q"), ("B", "t", "x & y")]
    assert [(r.src, r.tgt, r.weight) for r in edges.collect()] == [("A", "B", 2.0)]


def graph_text(n):
    """A GraphML document as other tools write it: indented, with quoted values, self-closed nodes and entities."""
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines += ['  <key id="d0" for="node" attr.name="entity_type" attr.type="string"/>', '  <key id="d1" for="node" attr.name="description" attr.type="string" />', '  <key id="d2" for="edge" attr.name="weight" attr.type="double"/>', '  <key id="d3" for="edge" attr.name="keywords" attr.type="string"/>', "  <graph edgedefault='undirected'>"]
    for i in range(n):
        if i % 5 == 0:
            lines.append(f'    <node id="&quot;N{i} &lt;é\u4e2d&gt;&quot;"/>')
        else:
            lines += [f'    <node id="N{i}">', f'      <data key="d0">"KIND{i % 3}"</data>', f'      <data key="d1">about > {"long " * (i % 40)} &amp; {i}</data>', "    </node>"]
    for i in range(n):
        lines += [f'    <edge source="N{i}" target="N{(i * 7) % n}">', *([f'      <data key="d2">{i / 4}</data>'] if i % 3 else []), f'      <data key="d3">k{i}</data>', "    </edge>"]
    return "\n".join([*lines, "  </graph>", "</graphml>"]) + "\n"


def test_small_ranges_of_a_large_graph_share_tasks(tmp_path):
    from quern.sources import graphml

    path = tmp_path / "g.graphml"
    path.write_text(graph_text(3000), encoding="utf-8")
    reader = graphml.Reader({"path": str(path), "range": 61})
    parts = reader.partitions()
    assert len(parts) <= graphml.TASKS + 1 and all(p.begin % 61 == 0 for p in parts)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == ["node"] * 3000 + ["edge"] * 3000 and [r["id"] for r in rows[1:3000]] == [f"N{i}" if i % 5 else f"N{i} <é\u4e2d>" for i in range(1, 3000)]


@pytest.mark.parametrize("split", [61, 1000, 1 << 20])
def test_graphml_in_ranges_equals_an_xml_parser(spark, tmp_path, split, monkeypatch):
    import xml.etree.ElementTree as ET

    path = tmp_path / "g.graphml"
    path.write_text(graph_text(60 if split < 100 else 400), encoding="utf-8")
    root = ET.parse(path).getroot()
    name = lambda t: "{http://graphml.graphdrawing.org/xmlns}" + t
    bare = lambda v: v.strip('"') if v is not None else None
    keys = {(k.get("for"), k.get("id")): k.get("attr.name") for k in root.iter(name("key"))}
    data = lambda e, kind: {keys[kind, d.get("key")]: d.text for d in e.iter(name("data"))}
    want_nodes = sorted((bare(e.get("id")), bare(d.get("entity_type")), bare(d.get("description"))) for e in root.iter(name("node")) for d in [data(e, "node")])
    want_edges = sorted((e.get("source"), e.get("target"), float(d.get("weight", 0)), d.get("keywords")) for e in root.iter(name("edge")) for d in [data(e, "edge")])
    nodes, edges = files.read_graphml(spark, str(path), split)
    assert nodes.rdd.getNumPartitions() > 1 or split > 1000
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, nodes.select("id", "entity_type", "description").collect())) == order(want_nodes)
    assert sorted(map(tuple, edges.select("src", "tgt", "weight", "keywords").collect())) == want_edges


def test_failed_graph_writes_leave_nothing(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "t", "d") for i in range(50)], "id string, entity_type string, description string").repartition(5)
    edges = spark.createDataFrame([("n1", "n2", 1.5)], "src string, tgt string, weight double")
    bad = nodes.withColumn("description", F.when(F.col("id") == "n33", F.raise_error(F.lit("broken"))).otherwise(F.col("description")))
    with pytest.raises(Exception, match="broken"):
        files.write_graphml(bad, edges, f"{tmp_path}/g")
    assert not os.path.exists(f"{tmp_path}/g") or not [f for f in os.listdir(f"{tmp_path}/g") if f.startswith("_MANIFEST")]
    files.write_graphml(nodes, edges, f"{tmp_path}/g")
    (tmp_path / "g" / "part-stray.graphml").write_text(graph_text(9))  # of a writer that died
    n, e = files.read_graphml(spark, f"{tmp_path}/g")
    assert n.count() == 50 and [tuple(r) for r in e.select("src", "tgt", "weight").collect()] == [("n1", "n2", 1.5)]


def test_snapshots_of_dead_and_racing_writers(spark, tmp_path):
    from quern.sources.snapshots import Conflict, Snapshots

    s = Snapshots(spark, f"{tmp_path}/table")
    assert s.read() is None and s.latest() is None
    assert s.write(spark.range(3)) == 1 and s.write(spark.range(5)) == 2
    # a writer that died before its pointer: its data is not read, and its number is free
    s.stage(spark.range(99), 3)
    assert s.read().count() == 5 and len(s.data_folders()) == 3
    # one that died while it wrote the pointer: readers keep the snapshot before, writers go on behind it
    (tmp_path / "table" / "commits" / f"{3:012d}").write_text('{"tok')
    assert s.read().count() == 5 and s.latest()[0] == 2 and s.write(spark.range(7)) == 4
    assert [s.read(n).count() for n in (1, 2, 3, 4)] == [3, 5, 5, 7]
    # two writers of one number: one wins, the other learns it
    a, b = s.stage(spark.range(11), 5), s.stage(spark.range(12), 5)
    s.commit(5, a)
    with pytest.raises(Conflict):
        s.commit(5, b)
    assert s.read().count() == 11
    # an update that lost the race begins again from the winner's rows
    seen = []

    def change(df):
        seen.append(df.count())
        if len(seen) == 1:
            Snapshots(spark, f"{tmp_path}/table").write(spark.range(20))
        return df.union(spark.range(1))

    assert s.update(change) == 7 and seen == [11, 20] and s.read().count() == 21


def test_vector_store_upserts_and_replays(spark, tmp_path):
    from quern.operators.embedding import Embedder, VectorStore, hashed_projection
    from quern.sources.snapshots import Snapshots

    e = hashed_projection(8)
    store = VectorStore(Snapshots(spark, f"{tmp_path}/v"), e)
    first = spark.createDataFrame([("a", 1, "red bolt"), ("b", 1, "blue ring"), ("b", 2, "blue ring two"), ("c", 1, None)], "id string, seq int, content string")
    store.upsert(first, "seq")
    rows = {r.id: r for r in store.read().collect()}
    assert rows["b"].seq == 2 and rows["c"].vector is None and rows["a"].vector == pytest.approx(e.rows(["red bolt"])[0].tolist())
    store.upsert(spark.createDataFrame([("a", 3, "red bolt"), ("d", 3, "")], "id string, seq int, content string"), "seq")
    rows = {r.id: r for r in store.read().collect()}
    assert sorted(rows) == ["a", "b", "c", "d"] and rows["a"].seq == 3 and rows["d"].vector == [0.0] * 8
    # a stream in several batches, run again with its checkpoint, and replayed from the beginning of a batch
    for i in range(3):
        spark.createDataFrame([(f"s{i}", i, f"text {i}"), ("s", i, f"last {i}")], "id string, seq int, content string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("id string, seq int, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store.upsert_stream(stream(), f"{tmp_path}/check", "seq")
    number, pointer = store.snapshots.latest()
    want = sorted(map(tuple, store.read().select("id", "seq", "content").collect()))
    assert pointer["batch"] == 2 and {"s0", "s1", "s2", "s"} <= {r[0] for r in want}
    commits = tmp_path / "check" / "commits"
    (commits / "2").unlink()
    (commits / ".2.crc").unlink(missing_ok=True)
    store.upsert_stream(stream(), f"{tmp_path}/check", "seq")
    assert store.snapshots.latest()[0] == number and sorted(map(tuple, store.read().select("id", "seq", "content").collect())) == want
    with pytest.raises(ValueError, match="dimensions"):
        Embedder(4, lambda t: [[0.0] * 3 for _ in t]).rows(["x"])


@pytest.mark.parametrize("limit", [60, 1 << 20])
def test_canaries_equal_contains(spark, limit):
    import random

    from quern.operators.canaries import canary_hits

    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))
    canaries = [(i, word()) for i in range(60)] + [(100, ""), (101, None), (102, "ab"), (103, "ab")]
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(900, None), (901, "")]
    c, t = spark.createDataFrame(canaries, "c long, s string"), spark.createDataFrame(texts, "k long, text string")
    got = sorted((r.k, r.c) for r in canary_hits(t, c, "k", "text", "c", "s", limit).collect())
    assert got == sorted((k, i) for k, x in texts if x is not None for i, s in canaries if s and s in x)


def test_loaders(spark, tmp_path):
    def write(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    h = files.load_humaneval(spark, write("h.jsonl", {"task_id": "H/0", "prompt": "def f():", "canonical_solution": "  return 1", "test": "assert f() == 1", "entry_point": "f"})).first()
    assert (h.task_id, h.benchmark, h.answer, h.tests) == ("H/0", "humaneval", "  return 1", ["assert f() == 1"])
    m = files.load_mbpp(spark, write("m.jsonl", {"task_id": 5, "text": "x", "code": "y", "test_list": []}, {"task_id": 11, "text": "x", "code": "y", "test_list": ["t"]})).collect()
    assert [(r.task_id, r.tests) for r in m] == [("mbpp/11", ["t"])]
    a = files.load_math(spark, write("a.jsonl", {"problem": "p", "level": "Level 1", "type": "Algebra", "solution": "so \\boxed{4}"})).first()
    assert (a.answer, a.level, a.subject, a.benchmark) == ("4", "Level 1", "Algebra", "math") and a.task_id.startswith("math/")
    one = spark.createDataFrame([(1,)], "a int")
    one.write.parquet(f"{tmp_path}/p1")
    one.write.parquet(f"{tmp_path}/p2")
    assert files.read_parquet_shards(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"]).count() == 2
