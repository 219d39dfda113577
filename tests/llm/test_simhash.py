import numpy as np
import xxhash

from quern.llm import simhash


def brute_print(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = [brute_print(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return fps, [least[find(i)] for i in range(len(rows))]


def test_bit_sliced_distance_equals_popcount():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 70, dtype=np.uint64)
    b = np.concatenate([a[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)), rng.integers(0, 2**64, 31, dtype=np.uint64), a[:20] ^ np.uint64(15), a[:20] ^ np.uint64(7)])
    want = np.bitwise_count(a[:, None] ^ b[None, :]) <= 3
    assert (simhash.within(simhash.planes(b), a, len(b)) == want).all()
    n = min(len(a), len(b))
    assert (simhash.within(simhash.planes(a[:n] ^ b[:n]), None, n)[0] == np.diag(want)[:n]).all()


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(9001, None), (9002, ""), (9003, "One two"), (9004, "one TWO"), (None, "one two"), (9003, "One two"), (None, "alone here now"), (9010, "x " * 30000)]
    fps, comps = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as component_id", "'x' as fp", "2 as _th", "3 as _id")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, comps)), key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(zip(comps, [i if c is None else 0 for i, c in enumerate(comps)])))


def test_hot_bucket_in_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUB", 16)
    rng = np.random.default_rng(2)
    fps = {0}
    while len(fps) < 150:
        base = list(fps)[int(rng.integers(len(fps)))]
        fps.add(base ^ (1 << int(rng.integers(0, 20))))
    fps |= {int(x) for x in rng.integers(0, 2**63, 40)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    fl = sorted(fps)
    forest = simhash.Forest()
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= 3:
                forest.link(a, b)
    want = {a: forest.find(a) for a in fl if a in forest.up}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_ties_of_one_id_and_text_are_decided(spark):
    rows = [(1, "some words of a text", k, {"a": k % 2}) for k in range(9)] + [(2, "other words entirely here", 0, None)]
    kept = []
    for n in (1, 4):
        df = spark.createDataFrame(rows[:: 1 if n == 1 else -1], "doc_id long, text string, n_chars long, more map<string,int>").repartition(n, "n_chars")
        out = simhash.keep_one(df)
        assert out.columns == df.columns
        kept.append(sorted((r.doc_id, r.n_chars) for r in out.collect()))
    assert kept[0] == kept[1] and [d for d, _ in kept[0]] == [1, 2]
