"""Experiment statistics: paired tables, intervals, distributions, subtotals, convergence and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import stats as S
from .tables import load

#: Graded pairs of the supplied tables: a document's quality label as base, its toxicity absence as method, by language.
_PAIR_SQL = "pairs AS (SELECT doc_id, lang, source, quality = 1 AS base, toxic = 0 AS method FROM documents JOIN labels USING (doc_id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("method"))


_CELL_SQL = f"""
WITH {_PAIR_SQL}
SELECT lang, count(*) AS n, sum((base AND method)::INT)::BIGINT AS both_right, sum((base AND NOT method)::INT)::BIGINT AS harm,
  sum((NOT base AND method)::INT)::BIGINT AS benefit, sum((NOT base AND NOT method)::INT)::BIGINT AS both_wrong FROM pairs GROUP BY lang
"""


@query(_CELL_SQL)
def paired_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 tables of paired verdicts."""
    b, m = F.col("base"), F.col("method")
    cell = lambda c, name: F.sum(c.cast("long")).alias(name)
    return pairs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), cell(b & m, "both_right"), cell(b & ~m, "harm"), cell(~b & m, "benefit"), cell(~b & ~m, "both_wrong"))


@query("""
SELECT lang, n, good, round(greatest((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 9) AS low,
  round(least((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 9) AS high
FROM (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(quality) / count(*)::DOUBLE AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)
""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals of label rates."""
    g = pairs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base").cast("long")).alias("good"))
    lo, hi = S.wilson(F.col("good"), F.col("n"))
    return g.select("lang", "n", "good", F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"))


@query(f"""
WITH {_PAIR_SQL}, c AS (SELECT source, sum((base AND NOT method)::INT) AS b, sum((NOT base AND method)::INT) AS c FROM pairs GROUP BY source)
SELECT source, b::BIGINT AS harm, c::BIGINT AS benefit, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))
  FROM (SELECT unnest(range(0, least(b, c)::BIGINT + 1)) AS i))) END, 9) AS p FROM c
""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact McNemar test by source."""
    b, m = F.col("base"), F.col("method")
    g = pairs(spark, sf_dir).groupBy("source").agg(F.sum((b & ~m).cast("long")).alias("harm"), F.sum((~b & m).cast("long")).alias("benefit"))
    return g.select("source", "harm", "benefit", F.round(S.mcnemar_exact("harm", "benefit"), 9).alias("p"))


@query()
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact binomial intervals of label rates by source."""
    g = pairs(spark, sf_dir).groupBy("source").agg(F.sum(F.col("base").cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    return g.select("source", "good", "n", S.clopper_pearson_low("good", "n").alias("low"), S.clopper_pearson_high("good", "n").alias("high"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of method against base by language."""
    return S.bootstrap_difference(pairs(spark, sf_dir), "base", "method", "lang")


@query("""
SELECT lang, round(min(n_chars), 6) AS low, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75,
  round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(max(n_chars), 6) AS high, round(avg(n_chars), 6) AS mean, count(*) AS n FROM documents GROUP BY lang
""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution summary with interpolated percentiles."""
    d = load(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    out = d.groupBy("lang").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.join(S.percentiles(d, ["lang"], "v", [0.25, 0.5, 0.75, 0.9, 0.95]), "lang").select("lang", *[F.round(c, 6).alias(c) for c in ("low", "p25", "p50", "p75", "p90", "p95", "high", "mean")], "n")


@query("""
SELECT source, n, round(mean, 9) AS mean, round(mean - 1.96 * sd / sqrt(n), 6) AS lower FROM (
  SELECT source, count(*) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS sd FROM documents GROUP BY source)
""")
def normal_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean - 1.96 sd / sqrt(n) with the sample deviation."""
    g = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("sd"))
    return g.select("source", "n", F.round("mean", 9).alias("mean"), F.round(F.col("mean") - 1.96 * F.col("sd") / F.sqrt("n"), 6).alias("lower"))


@query(f"""
WITH {_PAIR_SQL}, d AS (SELECT lang, method::INT - base::INT AS d FROM pairs)
SELECT lang, count(*) AS n, round(avg(d), 9) AS difference, round(avg(d) - 1.96 * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 9) AS low,
  round(avg(d) + 1.96 * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 9) AS high FROM d GROUP BY lang
""")
def paired_difference_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal interval of a paired accuracy difference."""
    d = pairs(spark, sf_dir).select("lang", (F.col("method").cast("int") - F.col("base").cast("int")).alias("d"))
    half = 1.96 * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 9).alias("difference"), F.round(F.avg("d") - half, 9).alias("low"), F.round(F.avg("d") + half, 9).alias("high"))


@query("""
SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS n, sum(quality)::BIGINT AS good
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)
""")
def subject_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts by language and source with subtotals."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    out = docs.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    named = lambda g, c: F.when(F.col(g) == 1, "ALL").otherwise(F.col(c)).alias(c)
    return out.select(named("gl", "lang"), named("gs", "source"), "n", "good")


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS status,
  count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by every combination of two dimensions and ALL."""
    li = load(spark, sf_dir, "lineitem")
    out = li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.grouping("l_returnflag").alias("gf"), F.grouping("l_linestatus").alias("gs"))
    return out.select(F.when(F.col("gf") == 1, "ALL").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("gs") == 1, "ALL").otherwise(F.col("l_linestatus")).alias("status"), "n", "suppliers")


@query("""
SELECT 'lang' AS dimension, lang AS value, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY source
""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two one-dimensional groupings from one scan."""
    load(spark, sf_dir, "documents").select("lang", "source", "n_chars").createOrReplaceTempView("_quern_docs")
    return spark.sql("""
        SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS value, count(*) AS n, sum(n_chars) AS chars
        FROM _quern_docs GROUP BY GROUPING SETS ((lang), (source))""")


#: Rounds of an optimiser: days of events as rounds, values as scores.
_ROUND_SQL = "rounds AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS round, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY 1)"


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return load(spark, sf_dir, "events").groupBy(day.alias("round")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ROUND_SQL} SELECT round, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM rounds")
def round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of each round."""
    return rounds(spark, sf_dir).select("round", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n").orderBy(F.desc("mean"), "round")


@query(f"""
WITH {_ROUND_SQL}, top AS (
  SELECT a.round, b.mean, b.sd, row_number() OVER (PARTITION BY a.round ORDER BY b.mean DESC, b.round DESC) AS r FROM rounds a JOIN rounds b ON b.round <= a.round
), y AS (SELECT round, avg(mean) AS y, sqrt(sum(sd * sd) / 9) AS se FROM top WHERE r <= 3 GROUP BY round),
d AS (SELECT round, y, se, y - lag(y) OVER (ORDER BY round) AS dy, sqrt(se * se + lag(se) OVER (ORDER BY round) ** 2) AS sd FROM y),
f AS (SELECT *, coalesce(abs(dy) <= 0.05 * sd, false) AS flat FROM d),
i AS (SELECT *, sum((NOT flat)::INT) OVER (ORDER BY round ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT round, round(y, 6) AS y, round(se, 6) AS se, flat, sum(flat::INT) OVER (PARTITION BY island ORDER BY round ROWS UNBOUNDED PRECEDING)::BIGINT AS streak,
  sum(flat::INT) OVER (PARTITION BY island ORDER BY round ROWS UNBOUNDED PRECEDING) >= 5 AS converged FROM i
""")
def convergence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convergence monitor: mean of the three best rounds so far, its standard error, change against the last round, streak of
    flat changes (z 0.05), converged from five on."""
    from ..operators.lifecycle import convergence

    c = convergence(rounds(spark, sf_dir), keep=3, z=0.05, least=5)
    return c.select("round", F.round("y", 6).alias("y"), F.round("se", 6).alias("se"), "flat", "streak", "converged")


@query(f"""
WITH {_ROUND_SQL}, b AS (SELECT round, mean, row_number() OVER (ORDER BY mean DESC, round) AS r FROM rounds)
SELECT round, round(mean, 6) AS mean, row_number() OVER (ORDER BY (round <> 1)::INT, r) AS position FROM b WHERE r <= 4
""")
def top_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best rounds; round 1 first if it is one of them."""
    best = rounds(spark, sf_dir).orderBy(F.desc("mean"), "round").limit(4)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("round") != 1).cast("int"), F.desc("mean"), "round"))
    return best.select("round", F.round("mean", 6).alias("mean"), place.alias("position"))


@query(f"""
WITH {_ROUND_SQL}, e AS (SELECT round, exp(0.2 * (mean * 100 - max(mean * 100) OVER ())) AS e, count(*) OVER () AS n FROM rounds)
SELECT round, round(0.3 / n + 0.7 * e / sum(e) OVER (), 9) AS probability FROM e
""")
def softmax_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection probabilities: 0.3 uniform, 0.7 softmax of 100 x score at 0.2."""
    r = rounds(spark, sf_dir).select("round", (F.col("mean") * 100).alias("s"))
    whole = Window.partitionBy(F.lit(0))
    e = r.select("round", F.exp(0.2 * (F.col("s") - F.max("s").over(whole))).alias("e"), F.count(F.lit(1)).over(whole).alias("n"))
    return e.select("round", F.round(0.3 / F.col("n") + 0.7 * F.col("e") / F.sum("e").over(whole), 9).alias("probability"))


@query(f"""
WITH {_ROUND_SQL}, e AS (SELECT round, exp(0.2 * (mean * 100 - max(mean * 100) OVER ())) AS e, count(*) OVER () AS n FROM rounds),
p AS (SELECT round, 0.3 / n + 0.7 * e / sum(e) OVER () AS p FROM e), c AS (SELECT round, sum(p) OVER (ORDER BY round ROWS UNBOUNDED PRECEDING) AS hi FROM p)
SELECT draw, min(round) AS round FROM (SELECT d AS draw, ('0x' || substr(sha256('draw' || d), 1, 8))::BIGINT / 4294967296.0 AS u FROM (SELECT unnest(range(0, 50)) AS d)) JOIN c ON hi > u GROUP BY draw
""")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty draws by cumulative probability against hash-derived uniforms (replayable)."""
    p = softmax_probabilities(spark, sf_dir)
    c = p.select("round", F.sum("p").over(Window.partitionBy(F.lit(0)).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)).alias("hi"))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("draw"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    draws = spark.range(50).select(F.col("id").alias("draw"), u.alias("u"))
    # a draw meets only the shares of its cell, an equality join
    cells = 1024
    low = F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("round")), F.lit(0.0))
    shares = c.withColumn("lo", low).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    met = draws.withColumn("cell", F.floor(F.col("u") * cells)).join(shares, "cell").filter("lo <= u and u < hi")
    return met.select("draw", "round")


def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rounds(spark, sf_dir).select("round", (F.col("mean") * 100).alias("s"))
    whole = Window.partitionBy(F.lit(0))
    e = r.select("round", F.exp(0.2 * (F.col("s") - F.max("s").over(whole))).alias("e"), F.count(F.lit(1)).over(whole).alias("n"))
    return e.select("round", (0.3 / F.col("n") + 0.7 * F.col("e") / F.sum("e").over(whole)).alias("p"))


#: Model calls of the supplied tables: events as calls, k of props as prompt tokens, the model by event id.
_CALL_SQL = """
calls AS (SELECT event_id, user_id, event_type AS purpose, ts, (['gpt-4o', 'gpt-4o-mini-2025', 'o3-mini', 'claude-3-5-sonnet-x', 'other'])[1 + (event_id % 5)::INT] AS model,
  CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) * 3 + 1 AS output_tokens FROM events)"""
_PRICE_SQL = """
price AS (SELECT * FROM (VALUES (0, 'gpt-4o', 0.0025::DOUBLE, 0.01::DOUBLE), (1, 'gpt-4o-mini', 0.00015, 0.0006), (2, 'gpt-4o-mini-2024-07-18', 0.00015, 0.0006),
  (3, 'claude-3-5-sonnet', 0.003, 0.015), (4, 'o3', 0.003, 0.015), (5, 'o3-mini', 0.0011, 0.0025)) AS p(ord, key, pin, pout)),
priced AS (SELECT model, pin, pout FROM (SELECT m.model, pin, pout, row_number() OVER (PARTITION BY m.model ORDER BY (key = m.model) DESC, ord) AS r
  FROM (SELECT DISTINCT model FROM calls) m JOIN price ON contains(m.model, key)) WHERE r = 1)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    models = F.array(*map(F.lit, ("gpt-4o", "gpt-4o-mini-2025", "o3-mini", "claude-3-5-sonnet-x", "other")))
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("purpose"), "ts", F.get(models, (F.col("event_id") % 5).cast("int")).alias("model"), (k * 10).alias("input_tokens"), (k * 3 + 1).alias("output_tokens")
    )


#: USD for 1000 tokens in declared order (input, output).
PRICES = (
    ("gpt-4o", 0.0025, 0.01),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-4o-mini-2024-07-18", 0.00015, 0.0006),
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("o3", 0.003, 0.015),
    ("o3-mini", 0.0011, 0.0025),
)


def price(model: str, which: int):
    """Price of a model column: exact name, else the first declared name that it contains, else 0. The table is a constant,
    so it is an expression rather than a join."""
    m = F.col(model)
    exact = [F.when(m == name, cost[which]) for name, *cost in PRICES]
    partial = [F.when(m.contains(name), cost[which]) for name, *cost in PRICES]
    return F.coalesce(*exact, *partial, F.lit(0.0))


@query(f"""
WITH {_CALL_SQL}, {_PRICE_SQL}
SELECT event_id, c.model, input_tokens, output_tokens, round(input_tokens / 1000.0::DOUBLE * coalesce(pin, 0) + output_tokens / 1000.0::DOUBLE * coalesce(pout, 0), 9) AS cost FROM calls c LEFT JOIN priced p ON p.model = c.model
""")
def price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs of calls by the price lookup."""
    cost = F.col("input_tokens") / 1000 * price("model", 0) + F.col("output_tokens") / 1000 * price("model", 1)
    return calls(spark, sf_dir).select("event_id", "model", "input_tokens", "output_tokens", F.round(cost, 9).alias("cost"))


@query(f"""
WITH {_CALL_SQL} SELECT purpose, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens
FROM calls GROUP BY purpose
""")
def ledger_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ledger totals by purpose."""
    total = F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")
    return calls(spark, sf_dir).groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), total)


@query(f"""
WITH {_CALL_SQL} SELECT CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 'peak' ELSE 'offpeak' END AS regime,
  count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM calls GROUP BY 1
""")
def cost_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by pricing regime: weekdays in two bands of UTC hours are peak."""
    weekday = F.dayofweek("ts").between(2, 6)
    band = F.hour("ts").between(1, 3) | F.hour("ts").between(6, 9)
    regime = F.when(weekday & band, "peak").otherwise("offpeak").alias("regime")
    return calls(spark, sf_dir).groupBy(regime).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(f"""
WITH {_CALL_SQL}, g AS (SELECT user_id, avg(input_tokens) AS base, avg(output_tokens) AS method, count(*) AS n FROM calls GROUP BY user_id)
SELECT user_id, round(base - method, 6) AS saving, CASE WHEN base - method > 0 THEN ceil(5000 / (base - method))::BIGINT END AS break_even_uses, round(5000 / n + method, 6) AS amortised FROM g
""")
def amortised_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-off cost of 5000 tokens spread over uses; uses to break even, null without a saving."""
    g = calls(spark, sf_dir).groupBy("user_id").agg(F.avg("input_tokens").alias("base"), F.avg("output_tokens").alias("method"), F.count(F.lit(1)).alias("n"))
    saving = F.col("base") - F.col("method")
    return g.select("user_id", F.round(saving, 6).alias("saving"), F.when(saving > 0, F.ceil(5000 / saving)).alias("break_even_uses"), F.round(5000 / F.col("n") + F.col("method"), 6).alias("amortised"))


@query("""
SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_linenumber <= 1) AS pass_1, bool_or(l_returnflag = 'R' AND l_linenumber <= 4) AS pass_4 FROM lineitem GROUP BY l_orderkey
""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the first k candidates is right."""
    right = F.col("l_returnflag") == "R"
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.bool_or(right & (F.col("l_linenumber") <= k)).alias(f"pass_{k}") for k in (1, 4)])


@query("""
SELECT o_orderpriority, count(*) AS n, sum(oracle::INT)::BIGINT AS oracle, sum(selected::INT)::BIGINT AS selected, (sum(oracle::INT) - sum(selected::INT))::BIGINT AS gap FROM (
  SELECT l_orderkey, bool_or(l_returnflag = 'R') AS oracle, bool_or(l_returnflag = 'R' AND l_linenumber = 1) AS selected FROM lineitem GROUP BY 1)
JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
""")
def oracle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right among all candidates against right in the selected one."""
    right = F.col("l_returnflag") == "R"
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(right).cast("long").alias("o"), F.bool_or(right & (F.col("l_linenumber") == 1)).cast("long").alias("s"))
    j = g.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("oracle"), F.sum("s").alias("selected"), (F.sum("o") - F.sum("s")).alias("gap"))


@query(f"""
WITH {_PAIR_SQL} SELECT lang, sum((NOT base AND method)::INT)::BIGINT AS positive, sum((base AND NOT method)::INT)::BIGINT AS negative,
  round(avg(method::INT) - avg(base::INT), 9) AS gain FROM pairs GROUP BY lang
""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive and negative transfer of a policy and its gain."""
    b, m = F.col("base"), F.col("method")
    return pairs(spark, sf_dir).groupBy("lang").agg(F.sum((~b & m).cast("long")).alias("positive"), F.sum((b & ~m).cast("long")).alias("negative"), F.round(F.avg(m.cast("int")) - F.avg(b.cast("int")), 9).alias("gain"))
