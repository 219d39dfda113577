"""State of skills over ordered usage: running scores, status machines, feedback, risk and audits (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as M
from ..operators import lifecycle as L
from .tables import load


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage: user = key, error = failure, ordered by (ts, event_id)."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "event_type", "value", F.date_trunc("hour", "ts").alias("hour"))


_ORDERED = "o AS (SELECT user_id AS key, list(event_type <> 'error' ORDER BY ts, event_id) AS oks FROM events GROUP BY 1)"


@query(f"""
WITH {_ORDERED} SELECT key, len(oks) AS calls, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(range(1, len(oks) + 1), lambda i: len(list_filter(oks[1:i], lambda x: x)) / i::DOUBLE)), lambda u, e: 0.5 * u + 0.5 * e), 9) AS utility FROM o
""")
def ema_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility: half the last one and half the empirical success, in order."""
    return L.usage_state(usage(spark, sf_dir), block="hour").select("key", F.col("calls").cast("long").alias("calls"), F.round("utility", 9).alias("utility"))


@query(f"""
WITH {_ORDERED}, u AS (SELECT key, oks, list_reduce(list_prepend(0.5::DOUBLE, list_transform(range(1, len(oks) + 1), lambda i: len(list_filter(oks[1:i], lambda x: x)) / i::DOUBLE)), lambda u, e: 0.5 * u + 0.5 * e) AS utility FROM o),
t AS (SELECT key, utility, len(oks) - coalesce(list_position(list_reverse(oks), true), len(oks) + 1) AS last, coalesce(list_position(list_reverse(oks), true) - 1, len(oks)) AS fails FROM u)
SELECT key, fails::BIGINT AS consecutive_failures, CASE WHEN key % 10 = 0 THEN 'draft' WHEN key % 10 = 1 AND key % 4 >= 2 THEN 'pruned' WHEN utility < 0.35 OR fails >= 2 THEN 'suppressed' ELSE 'active' END AS status FROM t
""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status after all usage: drafts stay, suppressed ones with failed audits are pruned, then utility and streak decide."""
    s = L.usage_state(usage(spark, sf_dir), block="hour")
    k = F.col("key") % 10
    before = F.when(k == 0, "draft").when(k == 1, "suppressed").otherwise("active")
    return s.select("key", F.col("streak").cast("long").alias("consecutive_failures"), M.skill_status(before, F.col("utility"), F.col("streak"), F.col("key") % 4).alias("status"))


@query(f"""
WITH {_ORDERED} SELECT key, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(oks, lambda x: CASE WHEN x THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END)), lambda u, d: greatest(0.0::DOUBLE, least(1.0::DOUBLE, u + d))), 6) AS audited,
  round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(oks, lambda x: CASE WHEN x THEN 0.1::DOUBLE ELSE -0.15::DOUBLE END)), lambda u, d: greatest(0.0::DOUBLE, least(1.0::DOUBLE, u + d))), 6) AS primitive FROM o
""")
def clamped_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit results (0.1 up or down) and primitive feedback (0.1 up, 0.15 down), clamped to [0, 1] at each step."""
    u = usage(spark, sf_dir).withColumn("up", F.when(F.col("ok"), 0.1).otherwise(-0.1)).withColumn("way", F.when(F.col("ok"), 0.1).otherwise(-0.15))
    walk = lambda step, name: L.clamped_fold(u, "key", "hour", ["ts", "seq"], step, 0.5, 0.0, 1.0).select("key", F.round("value", 6).alias(name))
    return walk("up", "audited").join(walk("way", "primitive"), "key")


@query("""
WITH s AS (SELECT user_id AS key, count(*) AS support, sum((event_type <> 'error')::INT)::BIGINT AS good, sum((event_type = 'error')::INT)::BIGINT AS bad FROM events GROUP BY 1)
SELECT key, support, greatest(0, support + good - bad)::BIGINT AS priority, CASE WHEN bad >= 2 AND bad >= good THEN 'suppressed' WHEN support >= 2 THEN 'active' ELSE 'draft' END AS status FROM s
""")
def template_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template support, priority and status after feedback (every event is an observation of a template)."""
    ok = F.col("ok").cast("long")
    s = usage(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("support"), F.sum(ok).alias("good"), F.sum(1 - ok).alias("bad"))
    status = F.when((F.col("bad") >= 2) & (F.col("bad") >= F.col("good")), "suppressed").when(F.col("support") >= 2, "active").otherwise("draft")
    return s.select("key", "support", F.greatest(F.lit(0), F.col("support") + F.col("good") - F.col("bad")).cast("long").alias("priority"), status.alias("status"))


_SIDES = """
s AS (SELECT event_type AS key, count(*) FILTER (user_id % 2 = 0) AS gn, count(*) FILTER (user_id % 2 = 0 AND value > 50) AS gs, count(*) FILTER (user_id % 2 = 1) AS un, count(*) FILTER (user_id % 2 = 1 AND value > 50) AS us FROM events GROUP BY 1)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    guided, good = F.col("user_id") % 2 == 0, F.col("value") > 50
    n = lambda c, a: F.count_if(c).alias(a)
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(n(guided, "gn"), n(guided & good, "gs"), n(~guided, "un"), n(~guided & good, "us"))


@query(f"""
WITH {_SIDES} SELECT key, CASE WHEN gn >= 5 AND un >= 3 THEN round(gs / gn::DOUBLE - us / un::DOUBLE, 9) END AS delta, CASE WHEN gn > 0 THEN round(gs / gn::DOUBLE, 9) ELSE 0 END AS guided_rate,
  CASE WHEN un > 0 THEN round(us / un::DOUBLE, 9) ELSE 0 END AS unguided_rate, gn + un AS support FROM s
""")
def contrastive_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided minus unguided success (null below 5 and 3 samples) and the rates (0 on empty)."""
    c = F.col
    g, u = F.when(c("gn") > 0, F.round(c("gs") / c("gn"), 9)).otherwise(0.0), F.when(c("un") > 0, F.round(c("us") / c("un"), 9)).otherwise(0.0)
    delta = F.when((c("gn") >= 5) & (c("un") >= 3), F.round(c("gs") / c("gn") - c("us") / c("un"), 9))
    return sides(spark, sf_dir).select("key", delta.alias("delta"), g.alias("guided_rate"), u.alias("unguided_rate"), (c("gn") + c("un")).alias("support"))


@query(f"""
WITH {_SIDES} SELECT key, CASE WHEN gn >= 5 AND gs / gn::DOUBLE - us / un::DOUBLE < -0.1 THEN 'suppressed' WHEN gn >= 3 AND gs / gn::DOUBLE < 0.3 THEN 'suppressed' ELSE 'active' END AS registry,
  CASE WHEN gn >= 5 AND un >= 3 AND gs / gn::DOUBLE < us / un::DOUBLE - 0.1 THEN 'suppressed' ELSE 'active' END AS bank FROM s
""")
def strategy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two suppression rules for strategies."""
    c = F.col
    g, u = c("gs") / c("gn"), c("us") / c("un")
    one = F.when((c("gn") >= 5) & (g - u < -0.1), "suppressed").when((c("gn") >= 3) & (g < 0.3), "suppressed").otherwise("active")
    two = F.when((c("gn") >= 5) & (c("un") >= 3) & (g < u - 0.1), "suppressed").otherwise("active")
    return sides(spark, sf_dir).select("key", one.alias("registry"), two.alias("bank"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 >= 3 AND p_size % 3 <= 1 AND p_retailprice < 1200 THEN 'prune' WHEN p_size % 5 >= 2 AND p_size % 3 = 0 THEN 'suppress' WHEN p_size % 3 > 0 AND p_size % 5 > p_size % 3 THEN 'demote' END AS action FROM part
""")
def transfer_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance action of each card, first match."""
    s = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", M.transfer_control(s % 3, s % 5, F.when(F.col("p_retailprice") < 1200, 0.2).otherwise(0.9)).alias("action"))


@query("""
SELECT user_id, round(sum(value / 100 * exp(-greatest(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts), 0) / 3600000000.0::DOUBLE / 72)), 6) AS risk, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id
""")
def decayed_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity decayed by age (e-folding of 72 hours at a fixed as-of time), and counts by source."""
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    risk = F.round(F.sum(M.decayed(F.col("value") / 100, age)), 6)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(risk.alias("risk"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""
WITH g AS (SELECT user_id AS key, count(*) AS n, sum((event_type = 'error')::INT) / count(*)::DOUBLE AS rate, max(event_id) AS last FROM events GROUP BY 1)
SELECT key, rate > 0.25 AS failing, n < 50 AS rare, (SELECT max(last) FROM g) - last > 500 AS idle, (rate > 0.25)::INT + (n < 50)::INT + ((SELECT max(last) FROM g) - last > 500)::INT >= 2 AS flagged FROM g
""")
def periodic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three audit dimensions and the flag at two of them."""
    g = usage(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("ok")).cast("int")).alias("rate"), F.max("seq").alias("last"))
    top = g.agg(F.max("last").alias("top"))
    f, r, i = F.col("rate") > 0.25, F.col("n") < 50, F.col("top") - F.col("last") > 500
    return g.join(F.broadcast(top)).select("key", f.alias("failing"), r.alias("rare"), i.alias("idle"), (f.cast("int") + r.cast("int") + i.cast("int") >= 2).alias("flagged"))


@query("""
SELECT event_type, count(*) AS n, list(DISTINCT user_id ORDER BY user_id)[1:5] AS exemplars FROM events WHERE value > 90 GROUP BY 1 HAVING count(*) >= 3
""")
def insight_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights from three samples or more, with five exemplars."""
    # counts a user first; the rank limit is applied in the tasks before the shuffle, so no list grows past five
    users = load(spark, sf_dir, "events").filter("value > 90").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    first = users.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))).filter("r <= 5")
    exemplars = first.groupBy("event_type").agg(F.array_sort(F.collect_list("user_id")).alias("exemplars"))
    n = users.groupBy("event_type").agg(F.sum("n").alias("n")).filter("n >= 3")
    return n.join(exemplars, "event_type").select("event_type", "n", "exemplars")


@query("""
WITH o AS (SELECT event_type AS key, list(CASE WHEN value > 50 THEN 0.05::DOUBLE ELSE -0.08::DOUBLE END ORDER BY ts, event_id) AS d FROM events GROUP BY 1)
SELECT key, round(list_reduce(list_prepend(0.0::DOUBLE, d), lambda u, x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, u + x))), 6) AS delta FROM o
""")
def policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy deltas after each episode, clamped to [-1, 1]."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 50).alias("ok"))
    e = e.withColumn("step", F.when(F.col("ok"), 0.05).otherwise(-0.08)).withColumn("block", F.date_trunc("hour", "ts"))
    return L.clamped_fold(e, "key", "block", ["ts", "seq"], "step", 0.0, -1.0, 1.0).select("key", F.round("value", 6).alias("delta"))


@query("""
WITH g AS (SELECT event_type AS motif, sum((value > 50)::INT) - sum((value <= 50)::INT) AS score, count(*) AS n FROM events GROUP BY 1)
SELECT motif, greatest(-1, least(1, score / n::DOUBLE)) > 0 AS favoured, CASE WHEN score > 0 THEN 'promote' WHEN score < 0 THEN 'demote' ELSE 'keep' END AS directive, n FROM g
""")
def meta_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directive of each motif by its clamped balance."""
    good = (F.col("value") > 50).cast("long")
    g = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("motif")).agg((F.sum(good) - F.sum(1 - good)).alias("score"), F.count(F.lit(1)).alias("n"))
    directive = F.when(F.col("score") > 0, "promote").when(F.col("score") < 0, "demote").otherwise("keep")
    return g.select("motif", (M.clamp(F.col("score") / F.col("n"), -1.0, 1.0) > 0).alias("favoured"), directive.alias("directive"), "n")


@query("""
SELECT key, min(doc_id) AS doc_id FROM (SELECT md5(lang || '|' || text) AS key, doc_id FROM documents) GROUP BY key
""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get-or-put cache: the first response under each argument digest."""
    key = F.md5(F.concat_ws("|", "lang", "text")).alias("key")
    return load(spark, sf_dir, "documents").groupBy(key).agg(F.min("doc_id").alias("doc_id"))
