"""Planner scores, strict joins and grading of sealed records, token positions, template usage and BPE chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as M
from ..functions import stats as S
from ..functions import tokens as K
from ..operators import curation as C
from ..operators import relational as R
from .tables import load

_MODES = "['no_seed', 'guard_only_seed', 'skeleton_only_seed', 'code_excerpt_seed']"


@query(f"""
WITH c AS (SELECT p_partkey, 0.18::DOUBLE * (p_size / 4.0::DOUBLE) + CASE WHEN p_size % 3 = 0 THEN 1.25::DOUBLE WHEN p_size % 3 = 1 THEN 0.85::DOUBLE ELSE -0.75::DOUBLE END + 0.9::DOUBLE * (p_retailprice / 500) - 1.15::DOUBLE * (p_size % 5 / 4.0::DOUBLE)
    - (p_size % 4 / 2.0::DOUBLE) - CASE WHEN p_type LIKE '%STEEL' THEN 1.25::DOUBLE ELSE 0 END AS u, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 3 END AS most FROM part),
m AS (SELECT *, CASE WHEN u >= 4.6 THEN 3 WHEN u >= 3.5 THEN 2 WHEN u >= 2.6 THEN 1 ELSE 0 END AS rank FROM c)
SELECT p_partkey, round(u, 4) AS utility, {_MODES}[least(rank, most) + 1] AS mode FROM m
""")
def transfer_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer utility of a candidate and the seed mode it allows; governance can only lower the mode."""
    s = F.col("p_size")
    override = F.when(s % 7 == 0, F.lit("guard_only_seed"))
    u = M.transfer_utility(s / 4, s % 3 == 0, s % 3 == 1, F.col("p_retailprice") / 500, s % 5 / 4, s % 4 / 2, F.col("p_type").like("%STEEL"))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(u, 4).alias("utility"), M.seed_mode(u, override).alias("mode"))


@query("""
SELECT p_partkey, round((p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT + CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN p_size % 4 = 0 THEN 0.75 ELSE 0 END + (p_type LIKE '%STEEL')::INT + p_retailprice / 1000
  + (p_size % 3 = 0)::INT + 1.0 + CASE WHEN p_size % 5 = 0 THEN 1.0 WHEN p_size % 4 = 0 THEN 0.5 ELSE -0.75 END + CASE WHEN p_type LIKE '%STEEL' THEN 0.5 ELSE 0 END + p_size / 50.0 + CASE WHEN p_size % 3 = 0 AND p_size > 20 THEN 0.25 ELSE 0 END, 6) AS total FROM part
""")
def skill_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall plus rerank score of a skill: semantic match, compatibility, utility, and a bonus for direct use."""
    s, steel = F.col("p_size"), F.col("p_type").like("%STEEL")
    total = M.skill_total(family=s % 2 == 0, benchmark=s % 3 == 0, entry=s % 5 == 0, signature=s % 4 == 0, pattern=steel, overlap=F.col("p_retailprice") / 1000, language=F.lit(True), function=F.lit(True), utility=s / 50, direct=s > 20)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(total, 6).alias("total"))


@query("""
WITH m AS (SELECT user_id AS skill, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), f AS (SELECT 'family' || (user_id % 5) AS family, count(*) FILTER (value > 99) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey, coalesce(m.n, 0) + coalesce(f.n, 0) AS hits, round(greatest(0, least(1.2, 1.0::DOUBLE - CASE WHEN coalesce(m.n, 0) + coalesce(f.n, 0) > 0 THEN least(0.45::DOUBLE, 0.25::DOUBLE * (coalesce(m.n, 0) + coalesce(f.n, 0))) ELSE 0 END - CASE WHEN c_acctbal < 0 THEN 0.25::DOUBLE ELSE 0 END)), 6) AS score
FROM customer LEFT JOIN m ON skill = c_custkey LEFT JOIN f ON family = 'family' || (c_nationkey % 5)
""")
def planner_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility of a skill with the planner's memory of failures: its own and those of its family count."""
    errors = load(spark, sf_dir, "events").filter("event_type = 'error'")
    own = errors.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("own"))
    family = errors.groupBy(F.concat(F.lit("family"), F.col("user_id") % 5).alias("family")).agg(F.count_if(F.col("value") > 99).alias("of_family"))
    c = load(spark, sf_dir, "customer").withColumn("family", F.concat(F.lit("family"), F.col("c_nationkey") % 5)).join(own, "c_custkey", "left").join(family, "family", "left")
    hits, no = F.coalesce("own", F.lit(0)) + F.coalesce("of_family", F.lit(0)), F.lit(False)
    return c.select("c_custkey", hits.alias("hits"), F.round(M.compatibility(no, F.col("c_acctbal") < 0, hits, no, no), 6).alias("score"))


@query("""
WITH t AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') AS t, ['challenge ' || item_id] AS c FROM benchmark)
SELECT item_id, t[1:1] AS visible, t[2:] AS hidden, list_concat(t[2:], c) AS stress FROM t
""")
def visible_hidden_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test is visible, the others are hidden, and stress tests are the hidden and the challenge ones."""
    parts = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: x != "")
    t = load(spark, sf_dir, "benchmark").select("item_id", parts.alias("t"), F.array(F.concat(F.lit("challenge "), "item_id")).alias("c"))
    hidden = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    return t.select("item_id", F.slice("t", 1, 1).alias("visible"), hidden.alias("hidden"), F.concat(hidden, "c").alias("stress"))


@query("""
WITH r AS (SELECT user_id, event_type <> 'error' AND value > 60 AS ok, row_number() OVER w AS n, sum((event_type <> 'error' AND value > 60)::INT) OVER w AS good FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS used, max(good)::BIGINT AS good, bool_or(n - good >= 3 AND good / n::DOUBLE < 0.3) AS suppressed FROM r GROUP BY 1
""")
def template_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates by use: suppressed for good once three failures meet a success rate under 0.3."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = ((F.col("event_type") != "error") & (F.col("value") > 60)).cast("long")
    e = load(spark, sf_dir, "events").select("user_id", F.count(F.lit(1)).over(w).alias("n"), F.sum(ok).over(w).alias("good"))
    bad = (F.col("n") - F.col("good") >= 3) & (F.col("good") / F.col("n") < 0.3)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"), F.max("good").alias("good"), F.bool_or(bad).alias("suppressed"))


@query("""
SELECT event_id, date_diff('second', TIMESTAMP '1970-01-01', coalesce(try_cast(s AS TIMESTAMP), TIMESTAMP '2030-01-01')) AS at FROM (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events)
""")
def iso_or_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times in seconds; unreadable ones take the as-of time, a parameter instead of the clock."""
    s = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    at = F.coalesce(F.try_to_timestamp(s), F.lit("2030-01-01").cast("timestamp"))
    return load(spark, sf_dir, "events").select("event_id", F.unix_seconds(at).alias("at"))


@query("""
SELECT doc_id, CASE WHEN p > 0 THEN round(n_chars / 4.0::DOUBLE * (length(text) - p - 3) / length(text), 6) END AS tokens_after FROM (SELECT *, strpos(text, 'the ') AS p FROM documents)
""")
def tokens_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens behind the first cue, estimated from its place in the text; null without a cue."""
    p, n = F.instr("text", "the "), F.length("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.when(p > 0, F.round(M.tokens_after(F.col("n_chars") / 4, p + 3, n), 6)).alias("tokens_after"))


@query("""
WITH a AS (SELECT p_partkey, p_size || CASE WHEN p_partkey % 2 = 0 THEN ' + ' ELSE '+' END || 'x' AS p, CASE p_partkey % 4 WHEN 0 THEN p_size || '+x' WHEN 1 THEN 'x + ' || p_size WHEN 2 THEN 'x+' || (p_size + 1) ELSE 'x' END AS r FROM part UNION ALL
  SELECT -p_partkey, p_size || '.0004', CASE WHEN p_partkey % 3 = 0 THEN '' || p_size WHEN p_partkey % 3 = 1 THEN p_size || '.01' ELSE p_size || ',000' END FROM part),
s AS (SELECT *, try_cast(replace(p, ',', '') AS DOUBLE) AS x, try_cast(replace(r, ',', '') AS DOUBLE) AS y FROM a)
SELECT p_partkey, p = r OR CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-3) ELSE regexp_replace(p, '\\s*([-+*/^])\\s*', '\\1', 'g') = regexp_replace(r, '\\s*([-+*/^])\\s*', '\\1', 'g')
  OR list_sort(list_transform(string_split(p, '+'), lambda t: trim(t))) = list_sort(list_transform(string_split(r, '+'), lambda t: trim(t))) END AS equal FROM s
""")
def answer_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers equal as text, as numbers (0.001), without spaces beside operators, or as sums in another order."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    part = load(spark, sf_dir, "part")
    r = F.when(k % 4 == 0, F.concat(n, F.lit("+x"))).when(k % 4 == 1, F.concat(F.lit("x + "), n)).when(k % 4 == 2, F.concat(F.lit("x+"), F.col("p_size") + 1)).otherwise("x")
    a = part.select(k, F.concat(n, F.when(k % 2 == 0, " + ").otherwise("+"), F.lit("x")).alias("p"), r.alias("r"))
    b = part.select(-k, F.concat(n, F.lit(".0004")), F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(n, F.lit(".01"))).otherwise(F.concat(n, F.lit(",000"))))
    return a.union(b).select("p_partkey", M.answers_equal("p", "r").alias("equal"))


@query("""
SELECT doc_id, CASE WHEN n_chars > 15000 THEN 'truncated' WHEN text IS NULL OR trim(text) = '' THEN 'missing' WHEN quality IS NULL THEN 'unknown' ELSE 'graded' END AS status,
  CASE WHEN n_chars > 15000 THEN false WHEN text IS NULL OR trim(text) = '' OR quality IS NULL THEN NULL ELSE quality = 1 END AS correct FROM documents LEFT JOIN labels USING (doc_id)
""")
def sealed_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed submissions graded offline: a truncated one is wrong, one without an answer or a readable label is unknown."""
    d, y = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    d = d.select("doc_id", "text", "n_chars").withColumn("seal", C.seal("doc_id", "text"))
    missing = F.col("text").isNull() | (F.trim("text") == "")
    status = F.when(F.col("n_chars") > 15000, "truncated").when(missing, "missing").when(F.col("quality").isNull(), "unknown").otherwise("graded")
    graded = R.after_sealing(d, y, "doc_id", C.seal("doc_id", "text") == F.col("seal"))
    return graded.select("doc_id", status.alias("status"), F.when(status == "truncated", False).when(status == "graded", F.col("quality") == 1).alias("correct"))


@query("SELECT l.doc_id, quality, toxic, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def strict_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their documents; a label without its document, or with two, is an error."""
    return R.strict_join(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query()
def skill_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of one subject with like features (Jaccard 0.6) and like steps (ratio 0.75): pairs of different contents, and each copy with the skill that stands for it."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("subject"), F.split("p_name", " ").alias("features"), F.col("p_type").alias("steps"))
    return C.like_pairs(p, "p_partkey", "subject", "features", "steps", 0.6, 0.75)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.select("lang", (F.col("toxic") == 0).alias("a"), (F.col("quality") == 1).alias("b"))


@query()
def bootstrap_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap with interpolated ends; unknown answers count as not confirmed."""
    known = paired(spark, sf_dir).select("lang", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return S.bootstrap_difference(known, "a", "b", "lang", ends="interpolated")


@query()
def bootstrap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of 10,000 draws with floor-index ends; any unknown answer leaves the group without an interval."""
    return S.bootstrap_difference(paired(spark, sf_dir), "a", "b", "lang", resamples=10_000, ends="floor")


@query()
def bpe_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 BPE tokens, 20 shared with the next."""
    return K.bpe_chunks(load(spark, sf_dir, "documents"), size=200, overlap=20)


@query()
def bpe_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits as texts in order of similarity, within 4000 BPE tokens."""
    from ..operators import graph as G
    from ..operators import vectors as V
    from .tables import query_vector

    hits = V.top_k(load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir))
    rows = load(spark, sf_dir, "documents").join(hits, F.col("doc_id") == F.col("vec_id")).select("doc_id", "similarity", K.token_count("text").cast("long").alias("tokens"))
    return G.budget_prefix(rows, "tokens", [F.desc("similarity"), F.col("doc_id")], 4000).select("doc_id", "similarity", "tokens", "running")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_partkey % 7 + 1 AS d, l_suppkey % 7 + 1 AS e, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE n % 3 WHEN 0 THEN q * e = (q + d - e) * d WHEN 1 THEN q = q + d - e ELSE d = e END AS same FROM a
""")
def typed_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer pairs made of each line's numbers, compared exactly by kind: fractions, linear expressions in another order, half-open intervals."""
    from ..functions import exact as X

    c = F.col
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").cast("long").alias("q"), (c("l_partkey") % 7 + 1).alias("d"), (c("l_suppkey") % 7 + 1).alias("e"))
    other = c("q") + c("d") - c("e")
    kind = c("l_linenumber") % 3
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    p = F.when(kind == 0, made("\\frac{", c("q"), "}{", c("d"), "}")).when(kind == 1, made(c("q"), "x + ", c("d"))).otherwise(made("[", c("q"), ", ", c("q") + c("d"), ")"))
    r = F.when(kind == 0, made(other, "/", c("e"))).when(kind == 1, made(c("d"), "+", other, "x")).otherwise(made("[", c("q"), ",", c("q") + c("e"), ")"))
    return li.select("l_orderkey", "l_linenumber", X.same_value(p, r).alias("same"))


@query("""
SELECT event_type, round(p - h, 6) AS low, round(p + h, 6) AS high, round(greatest(p2 - h2, 0), 6) AS low_90, round(least(p2 + h2, 1), 6) AS high_90 FROM (
  SELECT event_type, (r + z * z / (2 * n)) / (1 + z * z / n) AS p, z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h, (r + y * y / (2 * n)) / (1 + y * y / n) AS p2, y * sqrt(r * (1 - r) / n + y * y / (4 * n * n)) / (1 + y * y / n) AS h2
  FROM (SELECT event_type, count(*)::DOUBLE AS n, avg((value > 50)::INT) AS r, 1.959963984540054::DOUBLE AS z, 1.6448536269514722::DOUBLE AS y FROM events GROUP BY 1))
""")
def wilson_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals by the longer constant without clamping, and at 90 % with it."""
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    ends = [*S.wilson(F.col("k"), F.col("n"), 1.959963984540054, clamp=False), *S.wilson(F.col("k"), F.col("n"), 1.6448536269514722)]
    return g.select("event_type", *[F.round(c, 6).alias(a) for c, a in zip(ends, ("low", "high", "low_90", "high_90"))])


@query("""
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"missing":null,"size":' || p_size || '}') AS digest,
  substr(sha256('def f():' || chr(10) || '    return ' || p_size), 1, 16) AS code FROM part
""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a row's JSON with sorted keys, and of code without blank lines and trailing blanks."""
    from ..functions import tasks as K2

    c = F.col
    code = F.concat(F.lit("\ndef f():   \n\n    return "), c("p_size"), F.lit("  \n"))
    digest = K2.canonical_digest(size=c("p_size"), key=c("p_partkey"), brand=c("p_brand"), missing=F.lit(None).cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", digest.alias("digest"), K2.code_hash(code).alias("code"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:answer is|therefore|thus)\\b')) AS candidate, len(regexp_extract_all(text, '(?i)\\b(?:check|verify|confirm)\\b')) AS "check",
  len(regexp_extract_all(text, '(?i)\\b(?:wait|actually|instead|mistake)\\b')) AS revision,
  CASE WHEN a > 0 AND b > 0 AND c > 0 THEN [a, a + b + 2, a + b + 2 + c + 1] END AS stages FROM (
  SELECT *, CASE WHEN b > 0 THEN strpos(substr(low, a + b + 4), 'in') ELSE 0 END AS c FROM (SELECT *, CASE WHEN a > 0 THEN strpos(substr(low, a + 3), 'of') ELSE 0 END AS b FROM (SELECT *, lower(text) AS low, strpos(lower(text), 'the') AS a FROM documents)))
""")
def trace_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of candidates, checks and revisions in a trace, and the places of stages that must follow each other."""
    from ..functions import tasks as K2

    d = load(spark, sf_dir, "documents")
    counts = [c.cast("long") for c in K2.cue_counts("text")]
    return d.select("doc_id", *[c.alias(n) for c, n in zip(counts, K2.CUES)], F.transform(K2.ordered_stages("text", ["the", "of", "in"]), lambda x: x.cast("long")).alias("stages"))


@query("""
WITH r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, event_type, run, count(*) AS n, max(struct_pack(t := ts, i := event_id)) AS last FROM r GROUP BY ALL)
SELECT user_id, max(n) AS longest, arg_max(n, last) AS current, arg_max(event_type, last) AS current_type FROM s GROUP BY 1
""")
def equal_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest and current streak of equal values of each key."""
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", (F.row_number().over(w) - F.row_number().over(v)).alias("run"))
    s = r.groupBy("user_id", "event_type", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    return s.groupBy("user_id").agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"), F.max_by("event_type", "last").alias("current_type"))
