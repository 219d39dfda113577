import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.functions import text as N
from quern.operators import similarity


def lcs_ratio(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(max(row[j + 1], new[-1], row[j] + (a == b)))
        row = new
    return 2 * row[-1] / (len(x) + len(y))


def brute(rows, least, across=None):
    first = {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        if t is not None:
            first.setdefault(t, k)
    keys = sorted((k, t) for t, k in first.items())
    out = [(a, b, round(lcs_ratio(x, y), 9)) for i, (a, x) in enumerate(keys) for b, y in keys[i + 1 :] if x or y]
    return sorted(r for r in out if r[2] >= least)


def texts(seed, n, length, alphabet="abcdefgh "):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 1 + len(t) // 8)):
                at = rng.randint(0, len(t))
                if rng.random() < 0.5:
                    t.insert(at, rng.choice(alphabet))
                elif t:
                    t.pop(at - 1)
            out.append("".join(t))
        else:
            out.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, length))))
    return list(enumerate(out))


@pytest.mark.parametrize("least,q,length,alphabet", [(0.9, 3, 40, "abcdefgh "), (0.9, 2, 14, "ab"), (0.75, 3, 25, "abcdé\U0001f600"), (0.5, 2, 9, "abc"), (1.0, 3, 6, "ab")])
def test_every_pair_is_found(spark, monkeypatch, least, q, length, alphabet):
    monkeypatch.setattr(similarity, "SUB", 16)
    rows = texts(int(least * 100) + q, 130, length, alphabet) + [(900, None), (901, "a"), (902, "a"), (903, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.left, r.right, r.ratio) for r in similarity.similar_texts(df, "id", "text", least, q).collect())
    assert got == brute(rows, least)


def test_pairs_across_a_border(spark):
    rows = texts(7, 90, 30)
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in rows], "id long, text string, seen boolean")
    sides = {}
    for i, t in rows:
        sides.setdefault(t, set()).add(i % 3 == 0)
    own = dict(rows)
    want = [p for p in brute(rows, 0.8) if (True in sides[own[p[0]]] and False in sides[own[p[1]]]) or (False in sides[own[p[0]]] and True in sides[own[p[1]]])]
    got = sorted((r.left, r.right, r.ratio) for r in similarity.similar_texts(df, "id", "text", 0.8, across="seen").collect())
    assert got == want and want


def test_short_texts_meet_by_deletions_only(spark):
    rows = [(i, f"Supplier#{i * 37:09d}"[: 16 + i % 3]) for i in range(150)]
    one = spark.createDataFrame(rows, "_k long, _t string").selectExpr("min(_k) over (partition by _t) = _k as first", "_k", "_t", "true as _yes", "true as _no").filter("first").drop("first")
    want = brute(rows, 0.94)
    got = sorted((r._a, r._b, round(r._r, 9)) for r in similarity.short_pairs(one, 0.94).collect())
    assert got == want and len({len(dict(rows)[a]) - len(dict(rows)[b]) for a, b, _ in want}) > 2
    assert similarity.candidate_pairs(one, 0.94, over=similarity.short_length(0.94)).count() == 0


def test_hot_buckets_are_cut(spark):
    a = spark.range(1000).selectExpr("id as _a", "'hot' as gram")
    b = spark.range(700).selectExpr("id as _b", "'hot' as gram")
    x, y, keys = similarity.in_sub_blocks(a, b, ["gram"], "_a", "_b", sub=100)
    assert x.groupBy(*keys).count().agg({"count": "max"}).first()[0] < 160 and y.groupBy(*keys).count().agg({"count": "max"}).first()[0] < 160
    met = x.join(y, keys).select("_a", "_b")
    assert met.count() == 700_000 == met.distinct().count()


@pytest.mark.parametrize("quota", [None, 1, 2, 4])
def test_greedy_choice_equals_the_loop(spark, quota):
    rng = random.Random(quota or 0)
    n = 90
    rows = [(i, rng.randint(0, 5)) for i in range(n)]
    order = sorted(rows, key=lambda r: (r[1], rng.random()))
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(120)} | {(order[i][0], order[i + 1][0]) for i in range(0, 30)}
    chosen, count = set(), {}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for k, s in order:
        if (quota is None or count.get(s, 0) < quota) and not near.get(k, set()) & chosen:
            chosen.add(k)
            count[s] = count.get(s, 0) + 1
    df = spark.createDataFrame([(k, i, s) for i, (k, s) in enumerate(order)], "key long, place long, stratum int")
    p = spark.createDataFrame(sorted(pairs), "left long, right long")
    got = {r.key: r.chosen for r in similarity.first_apart(df, p, quota).collect()}
    assert {k for k, c in got.items() if c} == chosen and len(got) == n


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
def test_nearest_equals_all_pairs(spark, least):
    rng = random.Random(3)
    rows = [(i, [f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.randint(0, 12))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i != j and a and b:
                s = round(len(set(a) & set(b)) / len(set(a) | set(b)), 9)
                if s >= least and (i not in want or (-s, j) < (-want[i][1], want[i][0])):
                    want[i] = (j, s)
    got = {r.id: (r.other, r.sim) for r in similarity.nearest_by_words(df, "id", "words", least).collect()}
    assert got == want


def test_blocked_pairs_equal_the_matcher(spark, sf_dir):
    from quern.plans.curation import near_dup_verified

    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        rows[f"b{r.item_id}"], rows[f"v{r.item_id}"] = r.text, r.text + " again"
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows[f"c{r.conv_id}-{r.turn}"] = r.text
    df = spark.createDataFrame(sorted(rows.items()), "id string, text string").select("id", N.digit_mask("text").alias("t"))
    first = {}
    for k, t in sorted((r.id, r.t) for r in df.collect()):
        first.setdefault(t, k)
    keys = sorted((k, t) for t, k in first.items())
    want = []
    for i, (a, x) in enumerate(keys):
        for b, y in keys[i + 1 :]:
            if (x[:24] == y[:24] or x[-24:] == y[-24:]) and 2 * min(len(x), len(y)) >= 0.9 * (len(x) + len(y)):
                r = SequenceMatcher(None, x, y, autojunk=False).ratio()
                if r >= 0.9:
                    want.append((a, b, round(r, 9)))
    assert sorted((r.left, r.right, r.ratio) for r in near_dup_verified(spark, sf_dir).collect()) == want and want


def test_pairs_of_blocks_meet_within_them_only(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoin shrdlu\u00e9z-") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, k = {}, 0
    for block in range(40):
        head = f"{block:02d}" + "".join(rng.choice("abcdefgh") for _ in range(22))
        own = [head + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30 if block == 0 else 2)]
        for t in own + [x[: len(x) // 2] + rng.choice("xyz") + x[len(x) // 2 :] for x in own]:
            rows.setdefault(t, k := k + 1)
    rows.setdefault("", k + 1)
    one = spark.createDataFrame([(i * 7919 % 1009, t) for t, i in rows.items()], "_k long, _t string")
    ends = lambda c: F.array(F.left(c, F.lit(24)), F.right(c, F.lit(24)))
    all_ = sorted((r._k, r._t) for r in one.collect())
    near = [(i, x, j, y) for n, (i, x) in enumerate(all_) for j, y in all_[n + 1 :] if {x[:24], x[-24:]} & {y[:24], y[-24:]}]
    met = {sub: [(min(r._a, r._b), max(r._a, r._b)) for r in similarity.block_pairs(one, 0.9, ends, sub).collect()] for sub in (4, 256)}
    assert sorted(met[4]) == sorted(met[256]) and len(set(met[4])) == len(met[4]) <= len(near)
    want = sorted((i, j, round(r, 9)) for i, x, j, y in near if (r := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.9)
    got = similarity.similar_in_blocks(one.select(F.col("_k").alias("id"), F.col("_t").alias("text")), "id", "text", 0.9, ends)
    assert sorted((r.left, r.right, r.ratio) for r in got.collect()) == want and want
    assert set(met[4]) >= {(i, j) for i, j, _ in want}
