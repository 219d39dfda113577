import random

import pytest

from quern.functions import scan
from quern.operators import banks, policies, votes

OPS = "at long, action string, cards array<string>, into string, features array<string>, status string, harmful boolean, saving double, enough boolean"
CARDS = "card string, subject string, features array<string>, sources array<string>"


def op(at, action, cards, into=None, features=None, status=None, harmful=None, saving=None, enough=None):
    return (at, action, cards, into, features, status, harmful, saving, enough)


def test_history_of_merges_splits_and_maintenance(spark):
    cards = [("a", "s", ["f", "g"], ["t1"]), ("b", "s", ["f"], ["t2", "t1"]), ("c", "s", ["h"], ["t3"]), ("d", "u", ["k"], ["t4"])]
    ops = [
        op(1, "merge", ["a", "b"], "ab", ["f", "g"]), op(2, "merge", ["ab", "c"], "c", ["f", "g", "h"]), op(3, "split", ["c"], "c1", ["f"]), op(4, "split", ["c"], "c2", ["g", "h"]),
        op(5, "transition", ["d"], status="shadow"), op(6, "maintain", ["c1"], harmful=True, saving=9.0, enough=True), op(7, "maintain", ["c2"], harmful=False, saving=-1.0, enough=True),
        op(8, "maintain", ["d"], harmful=False, saving=-1.0, enough=False), op(9, "merge", ["c1", "c2"], "end", ["f"]),
    ]
    h = banks.bank_history(spark.createDataFrame(cards, CARDS), spark.createDataFrame(ops, OPS))
    got = sorted((r.card, r.valid_from, r.valid_to, r.version, r.status, ",".join(r.sources)) for r in h.collect())
    every = "t1,t2,t3"
    assert got == sorted([
        ("a", 0, 1, 1, "candidate", "t1"), ("a", 1, None, 1, "retired", "t1"), ("b", 0, 1, 1, "candidate", "t1,t2"), ("b", 1, None, 1, "retired", "t1,t2"),
        ("ab", 1, 2, 2, "candidate", "t1,t2"), ("ab", 2, None, 2, "retired", "t1,t2"), ("c", 0, 2, 1, "candidate", "t3"), ("c", 2, 3, 3, "candidate", every), ("c", 3, 4, 3, "quarantine", every), ("c", 4, None, 3, "quarantine", every),
        ("c1", 3, 6, 4, "candidate", every), ("c1", 6, 9, 4, "quarantine", every), ("c2", 4, 7, 4, "candidate", every), ("c2", 7, 9, 4, "retired", every), ("c1", 9, None, 4, "retired", every), ("c2", 9, None, 4, "retired", every),
        ("d", 0, 5, 1, "candidate", "t4"), ("d", 5, None, 1, "shadow", "t4"), ("end", 9, None, 5, "candidate", every),
    ], key=lambda r: (r[0], r[1]))
    assert {r.card: r.status for r in banks.bank_as_of(h, 2).collect()} == {"a": "retired", "b": "retired", "ab": "retired", "c": "candidate", "d": "candidate"}
    for bad, what in ((op(1, "merge", ["a", "d"], "x", ["f"]), "subjects"), (op(1, "split", ["b"], "x", ["g"]), "narrow"), (op(1, "transition", ["a"], status="active"), "admission"), (op(1, "merge", ["a", "nobody"], "x", ["f"]), "no such")):
        with pytest.raises(Exception, match=what):
            banks.bank_history(spark.createDataFrame(cards, CARDS), spark.createDataFrame([bad], OPS)).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_with_verdicts_that_are_not_transitive(spark, seed):
    rng = random.Random(seed)
    rows = [(t, c, None if rng.random() < 0.1 else str(rng.randint(0, 30) / 2), rng.random() < 0.9) for t in range(40) for c in rng.sample(range(20), rng.randint(1, 12))]
    rows += [(99, 4, None, True), (99, 2, "1", False)]
    want = {}
    for t in {r[0] for r in rows}:
        groups = []
        own = sorted((c, a if ok else None) for tt, c, a, ok in rows if tt == t)
        for c, a in own:
            if a is None:
                continue
            home = next((g for g in groups if abs(float(a) - g["first"]) <= 1), None)
            if home is None:
                groups.append({"first": float(a), "members": [c]})
            else:
                home["members"].append(c)
        best = min((g["members"] for g in groups), key=lambda m: (-len(m), min(m)), default=None)
        want[t] = (min(best), len(best)) if best else (own[0][0], 0)
    df = spark.createDataFrame(rows, "task long, candidate long, answer string, ok boolean").repartition(5)
    got = {r.task: (r.chosen, r.votes) for r in votes.equivalence_votes(df, "task", "candidate", "answer", votes.near_numbers(1.0), "ok").collect()}
    assert got == want


def test_spans_by_hand_and_against_a_walk():
    text = r"x $a$ \$5 and \[ b \(c\) \] then \boxed{\frac{1}{2}} $$d$e$$ \fbox {z} \boxed{open $"
    assert [(k, v) for k, _, _, v in sorted(scan.box_spans(text) + scan.maths_spans(text), key=lambda s: s[1])] == [("maths", "a"), ("maths", " b \\(c\\) "), ("boxed", "\\frac{1}{2}"), ("maths", "d$e"), ("boxed", "z")]
    assert all(text[a:z].endswith(("}", "$", "]", ")")) for _, a, z, _ in scan.box_spans(text) + scan.maths_spans(text))
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["{", "}", "$", "$$", "\\[", "\\]", "\\(", "\\)", "a ", "\n\n", "\n \n", " "]) for _ in range(rng.randint(0, 25)))
        want = []
        gaps = [(i, j) for i, j in find_gaps(t)]
        begin = 0
        for i, j in gaps:
            p = t[:i]
            ok = p.count("{") == p.count("}") and p.count("\\[") == p.count("\\]") and p.count("\\(") == p.count("\\)") and p.count("$$") % 2 == 0 and p.replace("$$", "").count("$") % 2 == 0
            if t[begin:i].strip() and ok:
                want.append(i)
            begin = j
        assert scan.safe_ends(t) == want, t


def find_gaps(t):
    """Runs of white space with two line breaks, from the first break to the last."""
    i = 0
    while i < len(t):
        if t[i] == "\n":
            j = i + 1
            while j < len(t) and t[j].isspace():
                j += 1
            last = t.rfind("\n", i + 1, j)
            if last > i:
                yield i, last + 1
                i = last + 1
                continue
        i += 1


def test_policies_in_several_batches_equal_the_fold(spark, sf_dir, tmp_path):
    from quern.plans.streams import episodes
    from quern.streaming import usage

    usage.with_state_store(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    for i in range(3):  # files in the order of time
        part = events.orderBy("ts").limit((i + 1) * n // 3).orderBy("ts", ascending=False).limit((i + 1) * n // 3 - i * n // 3)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(usage.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", usage.F.col("ts").cast("timestamp"))
    rows = usage.run_once(policies.policy_stream(policies.policy_steps(episodes(stream))), "update")
    assert rows.select("batch").distinct().count() == 3
    by = ["dimension", "name", "channel", "subtype"]
    last = rows.groupBy(*by).agg(usage.F.max_by("delta", "batch").alias("delta"))
    want = policies.policy_deltas(policies.policy_steps(episodes(events)))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
