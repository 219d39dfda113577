"""Paired statistics, intervals and distributions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def safe_rate(a: Column, n: Column, empty: float | None = None) -> Column:
    """a / n, or ``empty`` where n is 0."""
    return F.when(n > 0, a / n).otherwise(F.lit(empty).cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.96, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson interval; null at n = 0."""
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    lo, hi = middle - half, middle + half
    if clamp:
        lo, hi = F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))
    return F.when(n > 0, lo), F.when(n > 0, hi)


def log_factorial_table(n: int) -> list[float]:
    out = [0.0]
    for k in range(1, n + 1):
        out.append(out[-1] + math.log(k))
    return out


@pandas_udf(DoubleType())
def mcnemar_exact(b, c):
    """Two-sided exact McNemar p of the discordant counts: the binomial tail at one half, doubled, 1 at most."""

    def p(x, y):
        x, y = int(x), int(y)
        n, k = x + y, min(x, y)
        if n == 0:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * sum(math.exp(v - top) for v in logs))

    return b.combine(c, p)


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def _bisect(good, lo: float = 0.0, hi: float = 1.0, steps: int = 70) -> float:
    for _ in range(steps):
        mid = (lo + hi) / 2
        if good(mid):
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


@pandas_udf(DoubleType())
def clopper_pearson_low(k, n):
    """Lower end of the exact 95 % interval by bisection of the tail; null at n = 0."""
    return k.combine(n, lambda x, m: None if not m else 0.0 if not x else _bisect(lambda p: _tail(int(x), int(m), p) >= 0.025))


@pandas_udf(DoubleType())
def clopper_pearson_high(k, n):
    """Upper end of the exact 95 % interval; null at n = 0."""
    return k.combine(n, lambda x, m: None if not m else 1.0 if x == m else _bisect(lambda p: _tail(int(x) + 1, int(m), p) >= 0.975))


def bootstrap_difference(pairs: DataFrame, a: str, b: str, by: str, resamples: int = 20_000, seed: int = 7, ends: str = "order") -> DataFrame:
    """(by, n, difference, low, high): 95 % interval of mean(b) - mean(a) over paired booleans.

    A resample of n pairs draws multinomial counts of the three possible differences, so a group is three counts
    (aggregated by Spark) and nothing of the size of the data reaches Python. ends: "order" takes order statistics, "interpolated" linear
percentiles, "floor" the draws at the floor of 0.025 and 0.975 times the last index. A group with an unknown answer has no difference and no ends."""
    d = F.col(b).cast("int") - F.col(a).cast("int")
    counts = pairs.groupBy(by).agg(*[F.sum((d == v).cast("long")).alias(name) for name, v in (("worse", -1), ("same", 0), ("better", 1))], F.count_if(d.isNull()).alias("unknown"))

    def draw(batches):
        for pdf in batches:
            low, high = [], []
            pdf = pdf.fillna({"worse": 0, "same": 0, "better": 0})
            for w, s, g, unknown in zip(pdf.worse, pdf.same, pdf.better, pdf.unknown):
                n = int(w + s + g)
                if unknown or not n:
                    low.append(None)
                    high.append(None)
                    continue
                rng = np.random.default_rng([seed, int(w), int(s), int(g)])
                x = rng.multinomial(n, np.array([w, s, g]) / n, size=resamples)
                drawn = np.sort((x[:, 2] - x[:, 0]) / n)
                if ends == "interpolated":
                    a, z = np.quantile(drawn, [0.025, 0.975])
                elif ends == "floor":
                    a, z = drawn[int(0.025 * (resamples - 1))], drawn[int(0.975 * (resamples - 1))]
                else:
                    a, z = drawn[int(0.025 * resamples)], drawn[int(0.975 * resamples) - 1]
                low.append(a)
                high.append(z)
            n = (pdf.worse + pdf.same + pdf.better + pdf.unknown).astype("int64")
            difference = ((pdf.better - pdf.worse) / n).where(pdf.unknown == 0)
            yield pdf.assign(n=n, difference=difference, low=low, high=high)[[by, "n", "difference", "low", "high"]]

    kind = pairs.schema[by].dataType.simpleString()
    return counts.mapInPandas(draw, f"{by} {kind}, n long, difference double, low double, high double")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by with exact linearly interpolated percentiles of value (nulls left out) as p<share> columns.

    A group may hold most of the table, so its values meet in no single buffer: equal values are counted first, the range of a group is
    split into 1024 parts, ranks are running counts within a part plus those of the parts before, and only the two
    values beside each percentile are kept."""
    v = F.col(value).cast("double")
    g = rows.select(*by, v.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    same = lambda names, of: reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(of(c))), names, F.lit(True))
    ends = rows.select(*by, v.alias("_v")).groupBy(*[F.col(c).alias(f"_e_{c}") for c in by]).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(1023), F.floor(1024 * (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("int"))).otherwise(0)
    g = g.join(ends, same(by, lambda c: f"_e_{c}")).select(*by, "_v", "_n", part.alias("_part"))
    sizes = g.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*by)
    before = sizes.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_b_part"), (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_size"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    r = g.withColumn("_upto", inside).join(before, same([*by, "_part"], lambda c: f"_b{c}" if c == "_part" else f"_b_{c}"))
    last = F.col("_before") + F.col("_upto") - 1  # rank of the last of the equal values, from 0
    holds = lambda at: (last - F.col("_n") < at) & (at <= last)
    place = lambda s: s * (F.col("_size") - 1)
    needed = reduce(lambda a, b: a | b, [holds(end(place(s))) for s in shares for end in (F.floor, F.ceil)])
    out = []
    for s in shares:
        low, high = (F.max(F.when(holds(end(place(s))), F.col("_v"))) for end in (F.floor, F.ceil))
        at = s * (F.first("_size") - 1)
        out.append((low + (high - low) * (at - F.floor(at))).alias(f"p{round(100 * s)}"))
    return r.filter(needed).groupBy(*by).agg(*out)
