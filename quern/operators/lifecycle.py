"""Order-dependent state as folds over each key's ordered outcomes, and the same folds one event at a time for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_outcomes(usage: DataFrame) -> DataFrame:
    """(key, oks): outcomes of each key by (ts, seq)."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "seq", "ok")))
    return usage.groupBy("key").agg(F.transform(rows, lambda x: x["ok"]).alias("oks"))


def usage_state(usage: DataFrame, start: float = 0.5, alpha: float = 0.5, digits: int | None = None, block: str | None = None) -> DataFrame:
    """(key, calls, successes, streak, utility) after all usage: utility = (1 - alpha) x utility + alpha x successes / calls at
    each step (rounded half-even to ``digits`` if given); streak counts failures since the last success.

    With a block column (one that grows with the order, such as the hour) no task holds all rows of a key: a run of steps takes u to a u + b once the counts before it are known, so
    blocks are counted first, folded to a and b by themselves, and then folded in order. Rounding at each step has no such form and takes a key's rows together."""
    if block is not None and digits is None:
        return _usage_by_blocks(usage, start, alpha, block)

    def step(s: Column, ok: Column) -> Column:
        n, good = s["n"] + 1, s["good"] + F.when(ok, 1).otherwise(0)
        u = (1 - alpha) * s["u"] + alpha * (good / n)
        if digits is not None:
            u = F.bround(u, digits)
        return F.struct(n.alias("n"), good.alias("good"), F.when(ok, 0).otherwise(s["streak"] + 1).alias("streak"), u.alias("u"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("streak"), F.lit(float(start)).alias("u"))
    s = ordered_outcomes(usage).select("key", F.aggregate("oks", zero, step).alias("s"))
    return s.select("key", F.col("s.n").alias("calls"), F.col("s.good").alias("successes"), F.col("s.streak").alias("streak"), F.col("s.u").alias("utility"))


def _usage_by_blocks(usage: DataFrame, start: float, alpha: float, block: str) -> DataFrame:
    from pyspark.sql import Window

    rows = F.array_sort(F.collect_list(F.struct("ts", "seq", "ok")))
    part = usage.groupBy("key", F.col(block).alias("_block")).agg(F.transform(rows, lambda x: x["ok"]).alias("_oks"))
    part = part.select("key", "_block", "_oks", F.size("_oks").cast("long").alias("_n"), F.size(F.filter("_oks", lambda x: x)).cast("long").alias("_good"))
    past = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    part = part.withColumns({"_n0": F.coalesce(F.sum("_n").over(past), F.lit(0)), "_good0": F.coalesce(F.sum("_good").over(past), F.lit(0))})

    def step(s: Column, ok: Column) -> Column:
        n, good = s["n"] + 1, s["good"] + F.when(ok, 1).otherwise(0)
        return F.struct(n.alias("n"), good.alias("good"), F.when(ok, 0).otherwise(s["streak"] + 1).alias("streak"), (s["whole"] & ~ok).alias("whole"), ((1 - alpha) * s["a"]).alias("a"), ((1 - alpha) * s["b"] + alpha * (good / n)).alias("b"))

    zero = F.struct(F.col("_n0").alias("n"), F.col("_good0").alias("good"), F.lit(0).alias("streak"), F.lit(True).alias("whole"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    folded = part.select("key", F.struct("_block", F.aggregate("_oks", zero, step).alias("f")).alias("_p")).groupBy("key").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))

    def then(s: Column, p: Column) -> Column:
        f = p["f"]
        return F.struct(f["n"].alias("n"), f["good"].alias("good"), (F.when(f["whole"], s["streak"]).otherwise(0) + f["streak"]).alias("streak"), (f["a"] * s["u"] + f["b"]).alias("u"))

    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).alias("streak"), F.lit(float(start)).alias("u"))
    s = folded.select("key", F.aggregate("_parts", first, then).alias("s"))
    return s.select("key", F.col("s.n").alias("calls"), F.col("s.good").alias("successes"), F.col("s.streak").alias("streak"), F.col("s.u").alias("utility"))


def next_state(state: tuple[int, int, int, float], ok: bool, alpha: float = 0.5) -> tuple[int, int, int, float]:
    """One step of usage_state in plain Python, for stateful streams."""
    n, good, streak, u = state
    n, good = n + 1, good + bool(ok)
    return n, good, 0 if ok else streak + 1, (1 - alpha) * u + alpha * good / n


def clamped_walk(oks: str | Column, start: float, up: float, down: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A value moved up or down by each outcome and clamped at each step."""
    return F.aggregate(oks, F.lit(float(start)), lambda u, ok: F.greatest(F.lit(low), F.least(F.lit(high), u + F.when(ok, up).otherwise(-down))))


def clamped_fold(df: DataFrame, key: str, block: str, order: list[str], step: str, start: float, lo: float, hi: float) -> DataFrame:
    """(key, value): start moved by every step of the key in order, clamped to [lo, hi] after each.

    A run of clamped steps is itself one: u -> min(max(u + shift, low), high). Each block of rows (a column that grows with the
    order, such as the hour) is folded to these three numbers by itself, then the blocks of a key are, so no task holds all rows of a key."""

    def then(state: Column, shift: Column, low: Column, high: Column) -> Column:
        bound = lambda c: F.least(F.greatest(c, low), high)
        return F.struct((state["shift"] + shift).alias("shift"), bound(state["low"] + shift).alias("low"), bound(state["high"] + shift).alias("high"))

    none = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(step).alias("_step"))))
    part = df.groupBy(key, block).agg(rows.alias("_rows"))
    part = part.select(key, block, F.aggregate("_rows", none, lambda s, r: then(s, r["_step"], F.lit(lo), F.lit(hi))).alias("_fold"))
    whole = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("_block"), "_fold"))).alias("_parts"))
    folded = F.aggregate("_parts", none, lambda s, p: then(s, p["_fold"]["shift"], p["_fold"]["low"], p["_fold"]["high"]))
    return whole.select(key, folded.alias("_all")).select(key, F.least(F.greatest(F.lit(start) + F.col("_all.shift"), F.col("_all.low")), F.col("_all.high")).alias("value"))


def convergence(rounds: DataFrame, keep: int = 3, z: float = 0.05, least: int = 5) -> DataFrame:
    """(round, y, se, flat, streak, converged) of rounds (round, mean, sd), one row a round, by a single walk in their order that holds the ``keep`` best rounds so far.

    y is their mean (ties: the later round) and se its standard error; a change is flat within z standard deviations, and ``least`` flat changes in a row are convergence."""

    def run(batches):
        import heapq
        import math

        import pyarrow as pa

        best: list[tuple[float, int, float]] = []
        last, streak = None, 0
        for b in batches:
            out = []
            for n, mean, sd in zip(*(b.column(c).to_pylist() for c in ("round", "mean", "sd"))):
                heapq.heappush(best, (mean, n, sd))
                if len(best) > keep:
                    heapq.heappop(best)
                y = sum(m for m, _, _ in sorted(best, reverse=True)) / len(best)
                se = math.sqrt(sum(s * s for _, _, s in sorted(best, reverse=True)) / keep**2)
                flat = last is not None and abs(y - last[0]) <= z * math.sqrt(se * se + last[1] ** 2)
                streak = streak + 1 if flat else 0
                last = (y, se)
                out.append((n, y, se, flat, streak, streak >= least))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["round", "y", "se", "flat", "streak", "converged"])

    walk = rounds.select(F.col("round").cast("long").alias("round"), F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd")).coalesce(1).sortWithinPartitions("round")
    return walk.mapInArrow(run, "round long, y double, se double, flat boolean, streak long, converged boolean")
