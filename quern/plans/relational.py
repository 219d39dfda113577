"""Relational queries: predicates with reasons, joins, aggregations, windows, top-k, set operations and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as M
from ..functions import text as N
from ..operators import relational as R
from .tables import load

# predicates ---------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, p_size, reasons FROM (SELECT p_partkey, p_size, list_filter([CASE WHEN p_size > 30 THEN 'too_large' END, CASE WHEN p_retailprice > 1500 THEN 'too_dear' END,
  CASE WHEN p_brand = 'Brand#11' THEN 'excluded_brand' END], lambda x: x IS NOT NULL) AS reasons FROM part)
""")
def hard_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failing rules of each row."""
    rules = M.reasons(too_large=F.col("p_size") > 30, too_dear=F.col("p_retailprice") > 1500, excluded_brand=F.col("p_brand") == "Brand#11")
    return load(spark, sf_dir, "part").select("p_partkey", "p_size", rules.alias("reasons"))


@query("""
SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_size > 30 THEN 'too_large' END, CASE WHEN p_retailprice > 1500 THEN 'too_dear' END,
  CASE WHEN p_brand = 'Brand#11' THEN 'excluded_brand' END], lambda x: x IS NOT NULL)) AS reason FROM part) GROUP BY reason
""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping exclusion reasons counted."""
    return hard_filter_reasons(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 30 THEN 'size' WHEN p_retailprice > 1500 THEN 'price' WHEN p_type LIKE '%BRASS' THEN 'type' END AS gate FROM part
""")
def first_failing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that rejects a row; null: admitted."""
    gate = M.first_reason(size=F.col("p_size") > 30, price=F.col("p_retailprice") > 1500, type=F.col("p_type").like("%BRASS"))
    return load(spark, sf_dir, "part").select("p_partkey", gate.alias("gate"))


@query("""
SELECT off, count(*) AS admitted FROM part CROSS JOIN (VALUES ('none'), ('size'), ('price')) AS s(off)
WHERE (off = 'size' OR p_size <= 30) AND (off = 'price' OR p_retailprice <= 1500) GROUP BY off
""")
def gate_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions with one gate disabled at a time: conditional counts in one pass instead of a product with the scenarios."""
    size, price = F.col("p_size") <= 30, F.col("p_retailprice") <= 1500
    one = load(spark, sf_dir, "part").agg(F.count_if(size & price).alias("none"), F.count_if(price).alias("size"), F.count_if(size).alias("price"))
    return one.unpivot([], ["none", "size", "price"], "off", "admitted")


@query("""
SELECT doc_id, (toxic = 0) AND ((quality = 1) OR NULL) AS all_known, NOT (toxic = 1) AS not_toxic, (lang = 'en') AND (quality = 1) AS ready FROM documents LEFT JOIN labels USING (doc_id)
""")
def three_valued_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger trees over nullable facts; unknown stays unknown."""
    j = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    facts = {"clean": F.col("toxic") == 0, "toxic": F.col("toxic") == 1, "good": F.col("quality") == 1, "english": F.col("lang") == "en"}
    return j.select(
        "doc_id",
        M.trigger({"all_of": ["clean", {"any_of": ["good", "no_such_fact"]}, {"optional": "toxic"}]}, facts).alias("all_known"),
        M.trigger({"not": "toxic"}, facts).alias("not_toxic"),
        M.trigger({"all_of": ["english", "good", {"guard": "toxic"}]}, facts).alias("ready"),
    )


@query("""
WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), 'the ') THEN 'the' END, CASE WHEN regexp_matches(lower(text), 'license') THEN 'license' END,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(text, '\\$\\$\\$|###') THEN 'noise' END], lambda x: x IS NOT NULL) AS features FROM documents)
SELECT doc_id, features, list_has_any(features, ['license', 'digit']) AND list_has_all(features, ['the']) AND NOT list_has_any(features, ['noise']) AS matches FROM f
""")
def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex features, and the trigger / precondition / negative rule on them."""
    t = F.col("text")
    feats = M.reasons(the=F.lower(t).rlike("the "), license=F.lower(t).rlike("license"), digit=t.rlike("[0-9]"), noise=t.rlike(r"\$\$\$|###"))
    f = load(spark, sf_dir, "documents").select("doc_id", feats.alias("features"))
    lit = lambda *x: F.array(*map(F.lit, x))
    ok = F.arrays_overlap("features", lit("license", "digit")) & (F.size(F.array_except(lit("the"), "features")) == 0) & ~F.arrays_overlap("features", lit("noise"))
    return f.withColumn("matches", ok)


@query("SELECT doc_id, regexp_matches(text, '(?i)(token|password|secret|api.?key)\\s*=') AS leaks, contains(text, 'License') AS canary FROM documents")
def leakage_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak regex and canary substring."""
    return load(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?i)(token|password|secret|api.?key)\s*=").alias("leaks"), F.col("text").contains("License").alias("canary"))


@query("""
SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 1500 THEN 'length' WHEN regexp_matches(text, '[.!?]\\s*$') THEN 'stop' ELSE 'truncated' END AS finish FROM conversations
""")
def completion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish reason of each message."""
    t = F.col("text")
    finish = F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.length(t) > 1500, "length").when(t.rlike(r"[.!?]\s*\z"), "stop").otherwise("truncated")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", finish.alias("finish"))


@query("""
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size BETWEEN 11 AND 40) WHERE r <= 3
""")
def match_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range profile, then the best three of each key."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf_dir, "part").filter(F.col("p_size").between(11, 40)).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_brand", "p_partkey", "p_retailprice")


# joins --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, quality, quality = 1 AND toxic = 0 AS correct FROM documents LEFT JOIN labels USING (doc_id)")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with labels; a missing label leaves the verdict unknown."""
    j = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", "lang", "quality", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"))


@query("""
SELECT coalesce(a.custkey, b.custkey) AS custkey, CASE WHEN a.custkey IS NULL THEN 'right' ELSE 'left' END AS side
FROM (SELECT DISTINCT c_custkey AS custkey FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F') b ON a.custkey = b.custkey
WHERE a.custkey IS NULL OR b.custkey IS NULL
""")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two runs has."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    b = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return R.unmatched(a, b, ["custkey"])


@query("""
SELECT a.o_orderstatus AS before, b.o_orderstatus AS after, count(*) AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND NOT (a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus) GROUP BY 1, 2
""")
def version_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed verdicts between two versions (null-safe), counted."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("after"))
    j = o.join(b, "o_orderkey").filter(~F.col("o_orderstatus").eqNullSafe(F.col("after")))
    return j.groupBy(F.col("o_orderstatus").alias("before"), "after").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.doc_id, b.doc_id AS twin FROM documents a JOIN (SELECT sha256(lower(trim(text))) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 2) b ON sha256(lower(trim(a.text))) = b.h AND a.doc_id <> b.doc_id
""")
def digest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join by digest of the normalised text where exactly one partner exists."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    two = d.groupBy("h").agg(F.min("doc_id").alias("twin"), F.count(F.lit(1)).alias("n")).filter("n = 2").select("h", "twin")
    return d.join(two, "h").filter("doc_id <> twin").select("doc_id", "twin")


@query("""
SELECT user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type = 'purchase' AND a.event_id < b.event_id AND a.ts::DATE = b.ts::DATE
""")
def pairs_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of purchases of one user and day."""
    p = load(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return p.select("user_id", "day", F.col("event_id").alias("first_id")).join(p.select("user_id", "day", F.col("event_id").alias("second_id")), ["user_id", "day"]).filter("first_id < second_id").select("user_id", "first_id", "second_id")


@query("SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.ts::DATE = e.ts::DATE AND d.event_type = 'signup')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose key (user and day) has no finished row yet."""
    ev = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ev.filter("event_type = 'error'").join(ev.filter("event_type = 'signup'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("event_id")


# aggregations -------------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, n, sum_bal, round(sum_bal / n, 6) AS mean FROM (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS sum_bal FROM customer GROUP BY 1)")
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means, best first."""
    total = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
    g = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), total.alias("sum_bal"))
    return g.withColumn("mean", F.round(F.col("sum_bal") / F.col("n"), 6)).orderBy(F.desc("mean"), "c_mktsegment")


@query("""
SELECT event_type, round(avg(value), 6) AS score, max(event_id) AS total_cost, round(max(event_id) / count(*)::DOUBLE, 6) AS avg_cost FROM events GROUP BY event_type
""")
def cumulative_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score; cost is cumulative, so its maximum is the total."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("score"), F.max("event_id").alias("total_cost"), F.round(F.max("event_id") / F.count(F.lit(1)), 6).alias("avg_cost"))


@query("""
SELECT o_orderpriority AS condition, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS passed, sum((o_orderstatus = 'F')::INT) / count(*)::DOUBLE AS rate,
  sum((o_totalprice > 200000)::INT)::BIGINT AS costly, CASE WHEN sum((o_orderstatus = 'F')::INT) > 0 THEN round(count(*) / sum((o_orderstatus = 'F')::INT)::DOUBLE, 9) END AS tries_per_pass,
  avg((o_custkey % 3 = 0)::INT) AS hit_rate, avg((o_custkey % 3 = 1)::INT) AS injection_rate, avg((o_custkey % 3 = 2)::INT) AS skip_rate,
  CASE WHEN sum((o_orderstatus = 'F')::INT) > 0 THEN round(sum(round(o_totalprice)::BIGINT) / sum((o_orderstatus = 'F')::INT)::DOUBLE, 6) END AS tokens_per_pass FROM orders GROUP BY 1
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass, hit, injection and skip rates and the costs of each condition; null where nothing passed."""
    ok = (F.col("o_orderstatus") == "F").cast("long")
    g = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("condition")).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("passed"), F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("costly"),
        *[F.avg((F.col("o_custkey") % 3 == k).cast("int")).alias(a) for k, a in enumerate(("hit_rate", "injection_rate", "skip_rate"))], F.sum(F.round("o_totalprice").cast("long")).alias("tokens"))
    tokens = F.when(F.col("passed") > 0, F.round(F.col("tokens") / F.col("passed"), 6)).alias("tokens_per_pass")
    return g.select("condition", "n", "passed", (F.col("passed") / F.col("n")).alias("rate"), "costly", F.when(F.col("passed") > 0, F.round(F.col("n") / F.col("passed"), 9)).alias("tries_per_pass"), "hit_rate", "injection_rate", "skip_rate", tokens)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts with distinct counts."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("""
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE r <= 2
""")
def top_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two most common values of each key; ties: first seen."""
    g = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))).filter("r <= 2").select("user_id", "event_type", "n")


@query("""
SELECT l_orderkey, answer, votes FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS answer, count(*) AS votes, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(l_linenumber), l_returnflag || l_linestatus) AS r
FROM lineitem GROUP BY 1, 2) WHERE r = 1
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent candidate answer; ties: lowest candidate index, then answer. Aggregations only: no sort of the candidates."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("answer"), "l_linenumber")
    g = li.groupBy("l_orderkey", "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("l_linenumber").alias("first"))
    best = F.min_by(F.struct("answer", "votes"), F.struct((-F.col("votes")).alias("v"), "first", "answer")).alias("b")
    return g.groupBy("l_orderkey").agg(best).select("l_orderkey", "b.answer", "b.votes")


@query("""
SELECT c_nationkey, max(c_custkey) FILTER (c_acctbal > 0) AS father, list(c_custkey ORDER BY c_custkey) FILTER (c_acctbal > 9000) AS success, list(c_custkey ORDER BY c_custkey) FILTER (c_acctbal < -900) AS failure FROM customer GROUP BY 1
""")
def experience_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes and failures of each father node (null lists where there are none)."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("c_custkey"))))
    none = lambda c: F.when(F.size(c) > 0, c)
    g = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("father"), ids(F.col("c_acctbal") > 9000).alias("s"), ids(F.col("c_acctbal") < -900).alias("f"))
    return g.select("c_nationkey", "father", none(F.col("s")).alias("success"), none(F.col("f")).alias("failure"))


@query("""
SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) >= 3
""")
def trace_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by a structural key with three distinct members at least."""
    g = load(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"), F.countDistinct("p_type").alias("d"))
    return g.filter("d >= 3").drop("d")


@query("""
SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) FILTER (event_type IN ('signup', 'purchase', 'error', 'view', 'click')) = 5 AND count(*) FILTER (value IS NULL) = 0
""")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that cover all actions with known verdicts (relational division)."""
    kinds = ["signup", "purchase", "error", "view", "click"]
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("event_type").isin(kinds), F.col("event_type"))).alias("k"), F.count_if(F.col("value").isNull()).alias("u"))
    return g.filter("k = 5 AND u = 0").select("user_id", "n")


@query("""
WITH s AS (SELECT event_type AS action, avg((value > 50)::INT) AS success, avg(event_id % 1000) AS cost FROM events GROUP BY 1)
SELECT action, round(success, 9) AS success, round(cost, 6) AS cost, row_number() OVER (ORDER BY success - cost / 100000 DESC, action) = 1 AS chosen FROM s
""")
def action_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, cost and the action of best utility."""
    s = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action")).agg(F.avg((F.col("value") > 50).cast("int")).alias("success"), F.avg(F.col("event_id") % 1000).alias("cost"))
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("success") - F.col("cost") / 100000), "action"))
    return s.select("action", F.round("success", 9).alias("success"), F.round("cost", 6).alias("cost"), (r == 1).alias("chosen"))


@query("""
WITH c AS (SELECT p_brand, p_partkey, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS r, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part)
SELECT p_brand, p_partkey FROM c WHERE r = 1 OR r = 2 AND best - score <= 0.25
""")
def distill_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each cluster, and the second within a margin of 0.25."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), F.desc("p_partkey"))
    c = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("r"), F.first("p_retailprice").over(w).alias("best"))
    return c.filter("r = 1 OR r = 2 AND best - p_retailprice <= 0.25").select("p_brand", "p_partkey")


@query("""
SELECT p_brand, name, median FROM (SELECT p_brand, median(p_retailprice) AS price, median(p_size::DOUBLE) AS size FROM part GROUP BY 1) UNPIVOT (median FOR name IN (price, size))
""")
def timing_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of several measures, one row a measure."""
    from ..functions.stats import percentiles

    p = load(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    long = p.unpivot(["p_brand"], ["price", "size"], "name", "value")
    return percentiles(long, ["p_brand", "name"], "value", [0.5]).withColumnRenamed("p50", "median")


# windows ------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id")


@query("""
SELECT user_id, event_id, sum((event_type <> 'error')::INT) OVER w / count(*) OVER w::DOUBLE AS pass_rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def cumulative_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running pass rate."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "events").select("user_id", "event_id", (F.sum((F.col("event_type") != "error").cast("int")).over(w) / F.count(F.lit(1)).over(w)).alias("pass_rate"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, sum((event_type = 'error')::INT)::BIGINT AS n FROM e GROUP BY 1, 2) GROUP BY user_id
""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of failures of each key (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    err = F.col("event_type") == "error"
    e = load(spark, sf_dir, "events").select("user_id", err.cast("long").alias("e"), F.sum((~err).cast("int")).over(w).alias("island"))
    return e.groupBy("user_id", "island").agg(F.sum("e").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""
WITH l AS (SELECT user_id, max(struct_pack(t := ts, i := event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1)
SELECT e.user_id, count(*) FILTER (ok IS NULL OR struct_pack(t := e.ts, i := e.event_id) > ok) AS trailing FROM events e JOIN l USING (user_id) GROUP BY 1
""")
def trailing_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success of each key."""
    seq = F.struct("ts", "event_id")
    w = Window.partitionBy("user_id")
    e = load(spark, sf_dir, "events").select("user_id", seq.alias("s"), F.max(F.when(F.col("event_type") != "error", seq)).over(w).alias("ok"))
    return e.groupBy("user_id").agg(F.count_if(F.col("ok").isNull() | (F.col("s") > F.col("ok"))).alias("trailing"))


@query("""
SELECT doc_id, line, first_at FROM (SELECT doc_id, pos, l AS line, min(pos) OVER (PARTITION BY doc_id, lower(trim(l))) AS first_at FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE pos > first_at AND trim(line) <> ''
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a document had before, with the place of the first one."""
    x = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("at"), "line")
    x = x.withColumn("first_at", F.min("at").over(Window.partitionBy("doc_id", F.lower(F.trim("line")))))
    return x.filter("at > first_at AND trim(line) <> ''").select("doc_id", "line", "first_at")


@query("SELECT user_id, (SELECT max(event_id) FROM events) - max(event_id) AS gap FROM events GROUP BY user_id")
def inactivity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes since the last use of each key; the overall maximum comes from the same aggregation."""
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    top = g.agg(F.max("m").alias("top"))
    return g.join(F.broadcast(top)).select("user_id", (F.col("top") - F.col("m")).alias("gap"))


@query("""
SELECT user_id, count(DISTINCT event_type) <= 3 AS looping FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1
""")
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last ten actions have three distinct ones at most."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).alias("r")).filter("r <= 10")
    return e.groupBy("user_id").agg((F.countDistinct("event_type") <= 3).alias("looping"))


@query("""
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY r, p_brand) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 6 ORDER BY turn LIMIT 72
""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns across groups: six members each, 72 in all."""
    r = load(spark, sf_dir, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("r <= 6")
    best = r.orderBy("r", "p_brand").limit(72)
    return best.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r", "p_brand")).alias("turn"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position FROM conversations")
def position_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each row in its category."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("position"))


# top-k --------------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents), q AS (SELECT w AS qw FROM t WHERE doc_id = 1)
SELECT doc_id, round(len(list_intersect(w, qw)) / len(list_distinct(list_concat(w, qw)))::DOUBLE, 9) AS jaccard FROM t, q WHERE doc_id <> 1 ORDER BY jaccard DESC, doc_id LIMIT 10
""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents nearest to document 1 by word sets."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    q = d.filter("doc_id = 1").select(F.col("w").alias("qw")).limit(1)
    s = d.filter("doc_id <> 1").join(F.broadcast(q)).select("doc_id", F.round(N.jaccard("w", "qw"), 9).alias("jaccard"))
    return s.orderBy(F.desc("jaccard"), "doc_id").limit(10)


@query("""
WITH recall AS (SELECT p_partkey, p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r, p_type FROM part),
kept AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice DESC, p_partkey) AS k FROM recall WHERE r <= greatest(4 * 3, 10) AND p_size <= 25)
SELECT p_type, p_partkey, k AS position FROM kept WHERE k <= 3
""")
def two_stage_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall max(4k, 10) by one score, filter, rerank to k = 3 by another."""
    p = load(spark, sf_dir, "part")
    recall = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    rerank = Window.partitionBy("p_type").orderBy("p_size", F.desc("p_retailprice"), "p_partkey")
    pool = p.withColumn("r", F.row_number().over(recall)).filter("r <= 12").filter("p_size <= 25")
    return pool.withColumn("position", F.row_number().over(rerank)).filter("position <= 3").select("p_type", "p_partkey", "position")


@query("""
SELECT route, arg_max AS chosen FROM (SELECT p_brand AS route, first(p_partkey ORDER BY p_retailprice - p_size DESC, p_partkey) AS arg_max FROM part WHERE p_size < 40 GROUP BY 1)
""")
def route_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of largest expected saving; ties by id."""
    p = load(spark, sf_dir, "part").filter("p_size < 40")
    best = F.max_by("p_partkey", F.struct((F.col("p_retailprice") - F.col("p_size")).alias("s"), -F.col("p_partkey")))
    return p.groupBy(F.col("p_brand").alias("route")).agg(best.alias("chosen"))


@query("""
WITH q AS (SELECT list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS qw FROM benchmark WHERE item_id = 0)
SELECT doc_id, overlap FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), qw)) AS overlap FROM documents, q) WHERE overlap > 3 ORDER BY overlap DESC, doc_id LIMIT 1
""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one document with most shared words, over three; the first wins ties."""
    q = load(spark, sf_dir, "benchmark").filter("item_id = 0").select(F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("qw")).limit(1)
    d = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w")).join(F.broadcast(q))
    s = d.select("doc_id", F.size(F.array_intersect("w", "qw")).cast("long").alias("overlap")).filter("overlap > 3")
    return s.orderBy(F.desc("overlap"), "doc_id").limit(1)


# sets ---------------------------------------------------------------------------------------------------------------


@query("""
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of id sets."""
    li = load(spark, sf_dir, "lineitem")
    r, a = (li.filter(F.col("l_returnflag") == f).select("l_partkey") for f in ("R", "A"))
    count = lambda df, name: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(r.intersect(a), "intersect").union(count(r.subtract(a), "except"))


@query("SELECT l_partkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1")
def multiset_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row removed for each match."""
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_partkey", "l_returnflag").exceptAll(li.filter("l_linenumber = 1").select("l_partkey", "l_returnflag"))


@query("""
SELECT user_id, list_slice(list(event_type ORDER BY first), 1, 5) AS seen FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1
""")
def ordered_dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in first-seen order, five at most."""
    g = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return g.groupBy("user_id").agg(F.slice(seen, 1, 5).alias("seen"))


@query("""
SELECT h, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\d+(\\.\\d+)?', '#', 'g')) AS h FROM documents) GROUP BY h
""")
def digit_mask_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each digit-masked text."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(N.digit_mask("text")).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"))


# nested -------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, list(turn || ' ' || role || ': ' || coalesce(text, '') ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def message_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation as one ordered array."""
    m = F.struct("turn", "role", "text")
    line = lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), line).alias("messages"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 0 THEN 'broken' ELSE 'json' END AS route FROM events
""")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read as it is, else from the slice between its braces."""
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    e = load(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    whole, cut = (F.from_json(c, "k bigint", {"mode": "PERMISSIVE"})["k"] for c in (F.col("raw"), N.json_slice("raw")))
    return e.select("event_id", F.coalesce(whole, cut).alias("k"), F.when(whole.isNull(), "broken").otherwise("json").alias("route"))


@query("""
SELECT n_nationkey, n_name AS answer, 'because ' || n_regionkey AS thought, CASE WHEN n_nationkey % 2 = 0 THEN 'x = 1' ELSE 'plain ' || n_name END AS code FROM nation
""")
def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML-tag fields and fenced code of responses."""
    tick = "`" * 3
    code = F.when(F.col("n_nationkey") % 2 == 0, F.lit(f"text\n{tick}python\nx = 1\n{tick}\nmore")).otherwise(F.concat(F.lit("plain "), "n_name"))
    raw = F.concat(F.lit("<thought>\nbecause "), F.col("n_regionkey").cast("string"), F.lit("\n</thought> <answer> "), "n_name", F.lit(" </answer>"))
    return load(spark, sf_dir, "nation").select("n_nationkey", N.xml_field(raw, "answer").alias("answer"), N.xml_field(raw, "thought").alias("thought"), N.code_fence(code).alias("code"))


@query("""
SELECT coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey, list_sort(list_distinct(list_concat(coalesce(a.v, []), coalesce(b.v, [])))) AS merged
FROM (SELECT n_regionkey, list(n_name) AS v FROM nation WHERE n_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT n_regionkey, list(n_name) AS v FROM nation WHERE n_nationkey > 9 GROUP BY 1) b ON a.n_regionkey = b.n_regionkey
""")
def map_of_lists_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of lists, a row a key, merged key by key without repeats."""
    n = load(spark, sf_dir, "nation")
    lists = lambda df, name: df.groupBy("n_regionkey").agg(F.collect_list("n_name").alias(name))
    two = lists(n.filter("n_nationkey < 15"), "a").join(lists(n.filter("n_nationkey > 9"), "b"), "n_regionkey", "full")
    empty = F.array().cast("array<string>")
    merged = F.array_sort(F.array_distinct(F.concat(F.coalesce("a", empty), F.coalesce("b", empty))))
    return two.select("n_regionkey", merged.alias("merged"))


@query("""
WITH a AS (SELECT event_type, sum(round(value)::BIGINT)::BIGINT AS da FROM events WHERE event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, sum(round(value)::BIGINT)::BIGINT AS db FROM events WHERE event_id % 3 = 1 GROUP BY 1)
SELECT event_id, coalesce(da, 0) + coalesce(db, 0) AS delta FROM events e LEFT JOIN a ON a.event_type = e.event_type LEFT JOIN b ON b.user_id = e.user_id
""")
def policy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy deltas of two dimensions added up, missing ones as 0."""
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    whole = F.sum(F.round("value").cast("long"))
    a = ev.filter("event_id % 3 = 0").groupBy("event_type").agg(whole.alias("da"))
    b = ev.filter("event_id % 3 = 1").groupBy("user_id").agg(whole.alias("db"))
    return ev.join(a, "event_type", "left").join(b, "user_id", "left").select("event_id", (F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0))).alias("delta"))


@query("SELECT n_regionkey, string_agg(n_name, ',' || chr(9) ORDER BY n_nationkey) AS line, list_slice(list(n_name ORDER BY n_nationkey), -3, -1) AS last FROM nation GROUP BY 1")
def joined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unquoted comma-tab lines, and the last three of an ordered list."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    g = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("x"))
    return g.select("n_regionkey", F.array_join("x", ",\t").alias("line"), F.when(F.size("x") > 3, F.slice("x", -3, 3)).otherwise(F.col("x")).alias("last"))
