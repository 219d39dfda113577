import random

import numpy as np

from quern.llm import decontaminate as D


def smith_waterman(w, v):
    best = 0
    row = [0] * (len(w) + 1)
    for y in v:
        new = [0] * (len(w) + 1)
        for j, x in enumerate(w, 1):
            new[j] = max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(4)
    ws = [rng.integers(0, 5, rng.integers(1, 40)) for _ in range(30)]
    vs = [rng.integers(1, 5, rng.integers(1, 25)) for _ in range(30)]
    got, _ = D.align(ws, vs)
    assert got.tolist() == [smith_waterman(list(w), list(v)) for w, v in zip(ws, vs)]


def edited(rng, words, rate):
    out = []
    for x in words:
        u = rng.random()
        if u < rate / 3:
            continue
        out.append("zq" + x[:2] if u < rate * 2 / 3 else x)
        if rate * 2 / 3 <= u < rate:
            out.append("inserted")
    return " ".join(out)


def test_whole_table_and_edited_copies(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(6)
    planted = {9000 + k: bench[k] for k in range(20)}
    docs += [(d, docs[k][1][:300] + " " + edited(rng, t.split(), 0.2) + " " + docs[k][1][300:600]) for k, (d, (_, t)) in enumerate(planted.items())]
    docs += [(None, bench[3][1]), (9100, None), (9101, ""), (9102, "of the " * 30000), (9100, None)]
    items = bench + [(900, None), (901, "a b"), bench[0], (902, "x " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id", "2 as score")
    out = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in out if r.contaminated}
    for d, (i, _) in planted.items():
        assert (d, i) in found
    assert (None, bench[3][0]) in found
    # brute force: every document against every item, plain alignment of the whole texts
    exact = {}
    sample = docs[:60] + docs[200:222]
    for d, t in sample:
        w = D.words_of(t)
        for i, b in bench:
            v = D.words_of(b)
            if set(v) & set(w) and len(set(v) & set(w)) > 8:
                s = smith_waterman(w[:4000], v)
                if s / (2 * len(v)) >= D.CONTAMINATED or s >= 2 * D.RUN_WORDS:
                    exact[d, i] = s
    ids = {d for d, _ in sample}
    assert {p for p in found if p[0] in ids and p[0] is not None} == {p for p in exact if p[0] is not None}
    kept = D.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    bad = {d for d, _ in found}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_blocks_and_empty_tables(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).filter("contaminated").collect()}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 15)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).filter("contaminated").collect()} == whole
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_clean_keeps_rows_of_one_id_apart(spark):
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(1, "before " + item + " after"), (1, "an innocent text"), (None, item), (None, "another one"), (2, None), (2, ""), (3, "an innocent text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as __q_id", "2 as th", "3 as _c1", "4 as item_id")
    got = D.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_strips_and_batches_lose_no_alignment():
    rng = np.random.default_rng(5)
    block = D.Items([(1, " ".join(f"w{k}" for k in rng.integers(0, 6, 11))), (2, "w1 w2 w3"), (3, " ".join(f"w{k}" for k in range(40)))])
    block.seed(np.zeros(block.size, np.int64), 0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 7, n)) for n in (5000, 3, 90, 700)]
    got = {(d, k): s for d, k, s, *_ in D.find(texts, block)}
    for d, t in enumerate(texts):
        seq = [block.vocab.get(w, 0) for w in D.words_of(t)]
        for k in (0, 1):
            whole = smith_waterman(seq, block.words[k].tolist()) / (2 * len(block.words[k]))
            assert got.get((d, k), 0) == (whole if (d, k) in got else 0) and ((d, k) in got or whole < 1)
    for a, z, n in ((0, 1000, 10), (5, 86, 10), (7, 88, 10), (0, 81, 10)):
        cut = D.strips(a, z, n)
        assert all(any(x <= i and i + 3 * n <= y for x, y in cut) for i in range(a, z - 3 * n + 1)) and cut[-1][1] == z
    rows = [(0, 2, 0, int(n)) for n in rng.integers(1, 90_000, 50)]
    batches = list(D.batches_of(rows, block))
    assert sorted(r for b in batches for r in b) == sorted(rows)
    assert all(len(b) == 1 or len(b) * max(r[3] - r[2] for r in b) <= D.CELLS for b in batches)


def test_seeds_that_all_items_share_are_split(monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    template = "please answer the following question with a single letter from the list"
    items = [(i, f"{template} {' '.join(rng.choice(words, 12))}") for i in range(300)]
    block = D.Items(items)
    block.seed(np.ones(block.size, np.int64), 10**9)
    texts = [f"{' '.join(rng.choice(words, 30))} {items[k][1]} {' '.join(rng.choice(words, 5))} {template}" for k in (3, 77, 298)] + [" ".join([template] * 40)]
    whole = D.find(texts, block)
    held = []
    chains = D._chains
    monkeypatch.setattr(D, "_chains", lambda at, lo, n, *more: (held.append(int(n.sum())), chains(at, lo, n, *more))[1])
    monkeypatch.setattr(D, "MEETINGS", 5_000)
    assert D.find(texts, block) == whole and len(held) > 20 and max(held) <= 10_000
    assert {(d, k) for d, k, *_ in whole} >= {(0, 3), (1, 77), (2, 298)}
