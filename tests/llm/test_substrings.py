import random

import numpy as np

from pyspark.sql import functions as F

from quern.llm import substrings


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def brute(rows):
    """Texts after removal, by the definition: chunk all texts, first holder by doc_id, runs."""
    chunked = []
    for d, t in rows:
        raw = (t or "").encode()
        data = np.frombuffer(raw, np.uint8)
        out, last = [], 0
        if raw:
            found = [int(x) for x in substrings.candidates(data)] if len(raw) > 1 else []
            for c in substrings.cuts(data, found, 0, len(raw)):
                out.append((last, c, raw[last:c]))
                last = c
        chunked.append((d, t, raw, out))
    first = {}
    for d, _, _, out in chunked:
        for _, _, h in out:
            if d is not None:
                first[h] = min(first.get(h, d), d)
    res = []
    for d, t, raw, out in chunked:
        seen, dup = set(), []
        for a, z, h in out:
            f = first.get(h)
            other = f is not None and (d is None or f < d)
            if other or h in seen:
                dup.append((a, z - a, f if other else d))
            seen.add(h)
        kept, last = b"", 0
        for a, z, _ in substrings.merge_runs(dup):
            kept += raw[last:a]
            last = z
        res.append((d, (kept + raw[last:]).decode() if t is not None else None))
    return res


def test_boundaries_resist_insertions():
    rng = random.Random(3)
    a = words(rng, 400).encode()
    b = b"inserted words here " + a[:900] + b"zz " + a[900:]
    parts = []
    for raw in (a, b):
        data = np.frombuffer(raw, np.uint8)
        ends = substrings.cuts(data, substrings.candidates(data).tolist(), 0, len(raw))
        parts.append({raw[x:y] for x, y in zip([0, *ends], ends)})
        assert max(y - x for x, y in zip([0, *ends], ends)) <= substrings.MAX_CHUNK
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])


def test_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [(i, words(rng, 150)) for i in range(60)]
    clean = dict(rows[20:])
    rows[:20] = [(i, t[: 50 + 17 * i] + "\n" + passage + "\n" + t[50 + 17 * i :]) for i, t in rows[:20]]
    rows += [(70, None), (71, ""), (72, "é" * 40000), (None, passage), (5, rows[5][1]), (74, words(rng, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as spans", "2 as digest", "3 as runs", "4 as _th", "5 as __q_id", "6 as _c0", "7 as _runs")
    out = substrings.deduplicated(df)
    assert out.columns == ["doc_id", "text", "digest", "runs", "_th", "__q_id", "_c0", "_runs", "removed_bytes", "spans"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute(rows), key=str)
    for r in got:
        if r.doc_id in clean:
            assert r.text == clean[r.doc_id] and not r.spans
        if r.doc_id is not None and 0 < r.doc_id < 20:
            assert r.removed_bytes > 0.4 * len(passage) and all(s["first"] == 0 for s in r.spans)


def test_runs_join_across_first_holders():
    assert substrings.merge_runs([(0, 50, 1), (50, 40, 2), (90, 50, 1)]) == [(0, 140, [1, 2])]
    assert substrings.merge_runs([(0, 50, 1), (50, 40, 2), (100, 90, 1)]) == []


def test_a_chunk_seen_earlier_does_not_split_a_passage(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    raw = passage.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = substrings.cuts(data, substrings.candidates(data).tolist(), 0, len(raw))
    # every other chunk of the passage also stands alone in an earlier document
    rows = [(k, words(rng, 30) + raw[a:z].decode() + words(rng, 30)) for k, (a, z) in enumerate(zip(ends, ends[1:])) if k % 2]
    rows += [(900, words(rng, 40) + passage + words(rng, 40)), (901, words(rng, 40) + passage + words(rng, 40))]
    got = {r.doc_id: r for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[901].removed_bytes > 0.6 * len(raw)


def test_rows_without_an_id_or_of_one_id_keep_apart(spark):
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(None, words(rng, 40) + (" é " + passage if k % 3 == 0 else "")) for k in range(400)]
    rows += [(1, passage), (2, words(rng, 30)), (2, words(rng, 30) + " " + passage), (2, "ß" * 300), (3, words(rng, 20) + " " + passage), (3, words(rng, 20) + " " + passage), (None, passage + " " + passage)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute(rows), key=str)
    assert sum(r.removed_bytes > 0.4 * len(passage) for r in got if r.doc_id is None) == 135


def test_boundaries_without_white_space_resist_insertions():
    rng = random.Random(9)
    a = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    parts = []
    for raw in (a.encode(), ("新" + a[:900] + "入" + a[900:]).encode()):
        data = np.frombuffer(raw, np.uint8)
        ends = substrings.cuts(data, substrings.candidates(data).tolist(), 0, len(raw))
        parts.append({raw[x:y].decode() for x, y in zip([0, *ends], ends)})
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.text) for r in substrings.deduplicated(docs).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_query_tells_other_documents_repeats_from_own(spark, tmp_path):
    from quern.llm.queries import op1_substring_dedup

    rng = random.Random(21)
    passage, own = words(rng, 60), words(rng, 60)
    rows = [(1, words(rng, 30) + " " + passage), (2, words(rng, 30) + " " + passage), (3, own + " " + words(rng, 20) + " " + own), (4, words(rng, 80)), (None, passage), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.repeated, r.repeated_inside) for r in op1_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, False, False), (2, True, False), (3, False, True), (4, False, False), (None, True, False), (None, False, False)], key=str)


def test_many_equal_rows_make_no_long_list(spark):
    text = " ".join(f"word{i} of a passage" for i in range(60))
    rows = [(None, text)] * 10_000 + [(5, text), (9, "x " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    longest = substrings.repeated_runs(df).select(F.max(F.size("runs"))).first()[0]
    assert longest <= len(text) // substrings.MIN_CHUNK + 1
    got = substrings.deduplicated(df)
    assert got.count() == len(rows) and got.filter("doc_id = 5 and text = '" + text + "'").count() == 1
