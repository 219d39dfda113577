"""Text and scoring queries: normalisers, extraction, token metrics and score formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as M
from ..functions import text as N
from .tables import load


@query("""
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')) AS h FROM documents
""")
def qa_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer normalisation (digest of the result)."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(N.qa_normalize("text")).alias("h"))


_F1_SQL = """
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM t),
c AS (SELECT conv_id, turn, sum(least(n, m)) AS same FROM (SELECT conv_id, turn, u, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS u FROM p) GROUP BY ALL)
  JOIN (SELECT conv_id, turn, u, count(*) AS m FROM (SELECT conv_id, turn, unnest(g) AS u FROM p) GROUP BY ALL) USING (conv_id, turn, u) WHERE u <> '' GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(2.0 * same / (len(w) + len(g)), 0), 9) AS f1 FROM p LEFT JOIN c USING (conv_id, turn) WHERE g IS NOT NULL
"""


@query(_F1_SQL)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset token F1 of each message against the next one (2 x same / both lengths)."""
    from pyspark.sql import Window

    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(N.qa_normalize("text"), " ").alias("w"))
    p = t.withColumn("g", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("g is not null")
    # the multiset intersection: 1 and -1 a token would need a window; two counts a word join on the word
    words = lambda c: p.select("conv_id", "turn", F.explode(c).alias("u")).filter("u <> ''").groupBy("conv_id", "turn", "u").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    same = words("w").join(words("g"), ["conv_id", "turn", "u"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n_w", "n_g")).alias("same"))
    f1 = F.coalesce(2.0 * F.col("same") / (F.size("w") + F.size("g")), F.lit(0.0))
    return p.join(same, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(f1, 9).alias("f1"))


@query("""
SELECT p_partkey, max(f1) AS f1 FROM (
  SELECT p_partkey, CASE WHEN same = 0 THEN 0 ELSE round(2.0 * same / (na + nb), 9) END AS f1 FROM (
    SELECT p_partkey, len(list_intersect(a, b)) AS same, len(a) AS na, len(b) AS nb FROM (SELECT p_partkey, list_distinct(string_split(lower(unnest([p_type, p_name])), ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_brand), ' ')) AS b FROM part))) GROUP BY 1
""")
def max_f1_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best F1 over pipe-separated alternatives."""
    gold = F.explode(F.split(F.concat_ws("|", "p_type", "p_name"), r"\|"))
    x = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("out"), gold.alias("alt")).filter("trim(alt) <> ''")
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("alt", "out"))
    same = F.size(F.array_intersect(a, b))
    return x.select("p_partkey", F.when(same == 0, 0.0).otherwise(F.round(2.0 * same / (F.size(a) + F.size(b)), 9)).alias("f1")).groupBy("p_partkey").agg(F.max("f1").alias("f1"))


#: Made answers, the same text for both SQL dialects: Spark's takes a backslash in a literal as an escape and DuckDB's doesn't,
#: so chr92 stands for it until chr(92) replaces it at run time.
_ANSWER = """
CASE p_partkey % 6
  WHEN 0 THEN 'work chr92boxed{ ' || p_size || ' } and chr92boxed{chr92frac{1}{' || p_size || '}}'
  WHEN 1 THEN 'So the sum. The answer is: ' || p_size || ',000 units.'
  WHEN 2 THEN 'first 12 then 3,456.50 and ' || p_size || ' left'
  WHEN 3 THEN 'steps #### ' || p_size || ',500'
  WHEN 4 THEN 'no number here' || chr(10) || '  last line ' || p_brand || ' '
  ELSE '(' || substr(p_brand, 1, 1) || ')' END"""


def made_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"replace({_ANSWER}, 'chr92', chr(92))")
    return load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", text.alias("a"))


_MADE_SQL = f"WITH m AS (SELECT p_partkey, p_size, replace({_ANSWER}, 'chr92', chr(92)) AS a FROM part)"


@query(_MADE_SQL + """
SELECT p_partkey, nullif(trim(regexp_extract(a, '\\\\boxed\\{([^}]+)\\}', 1)), '') AS first_box,
  coalesce(nullif(trim(regexp_extract(a, '\\\\boxed\\{([^}]+)\\}', 1)), ''), nullif(replace(trim(regexp_extract(a, '[Tt]he answer is[:\\s]*(.+?)[.\\n]', 1)), ',', ''), ''),
    CASE WHEN len(regexp_extract_all(a, '-?\\d[\\d,]*\\.?\\d*')) > 0 THEN replace(regexp_extract_all(a, '-?\\d[\\d,]*\\.?\\d*')[-1], ',', '') END, trim(string_split(trim(a), chr(10))[-1])) AS cascade,
  coalesce(nullif(replace(trim(regexp_extract(a, '####\\s*([^\\n]+)', 1)), ',', ''), ''), trim(a)) AS hashed,
  TRY_CAST(replace(regexp_extract_all(a, '[-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?')[-1], ',', '') AS DOUBLE) AS last_number,
  trim(lower(regexp_replace(a, '[\\(\\[\\{]([A-Za-z])[\\)\\]\\}]|([A-Za-z])[.:\\)]', '\\1\\2', 'g'))) AS option_label FROM m
""")
def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, cascade, marked answers, last numbers and option labels."""
    return made_answers(spark, sf_dir).select(
        "p_partkey", N.boxed_first("a").alias("first_box"), N.answer_cascade("a").alias("cascade"), N.hash_answer("a").alias("hashed"), N.last_number("a").alias("last_number"), N.option_label("a").alias("option_label")
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN chr(92) || 'frac{1}{' || p_size || '}' END AS box, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_size = 1 THEN '1' ELSE '1/' || p_size END END AS value, CASE WHEN p_partkey % 6 = 0 THEN true END AS nested FROM part
""")
def balanced_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last balanced box at any depth and its exact rational form (Arrow UDFs: regular expressions can't count braces)."""
    return made_answers(spark, sf_dir).select("p_partkey", N.boxed_balanced("a").alias("box")).withColumn("value", N.rational("box")).withColumn("nested", F.col("box").contains("{"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '500' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '.5' ELSE lower(p_brand) END AS normal FROM part
""")
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in comparable form."""
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('$', p_size, '.0') WHEN 1 THEN concat(' ', p_size, ',500%') WHEN 2 THEN concat(p_size, ' bolts') WHEN 3 THEN concat(p_size, '.50') ELSE concat(p_brand, ' ') END")
    return load(spark, sf_dir, "part").select("p_partkey", N.normalize_answer(raw).alias("normal"))


@query(_MADE_SQL + """
SELECT p_partkey, TRY_CAST(replace(regexp_extract_all(a, '[-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?')[-1], ',', '') AS DOUBLE) IS NOT NULL AND abs(TRY_CAST(replace(regexp_extract_all(a, '[-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?')[-1], ',', '') AS DOUBLE) - p_size) <= 0.000001 AS right_answer FROM m
""")
def numeric_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric equality within 1e-6; no number is wrong."""
    x = N.last_number("a")
    return made_answers(spark, sf_dir).select("p_partkey", (x.isNotNull() & F.coalesce(F.abs(x - F.col("p_size")) <= 1e-6, F.lit(False))).alias("right_answer"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size * 1000.0::DOUBLE END AS value FROM part
""")
def percent_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with thousands commas and percent signs."""
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_size, chr(92), '%') WHEN 1 THEN concat(p_size, ',000') ELSE 'none' END")
    return load(spark, sf_dir, "part").select("p_partkey", N.parse_number(raw).alias("value"))


@query("SELECT doc_id, ceil(strlen(text) / 3.0)::BIGINT AS tokens, len(regexp_split_to_array(text, '\\s+')) AS words FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-based token estimate and word count."""
    return load(spark, sf_dir, "documents").select("doc_id", N.token_estimate("text").alias("tokens"), F.size(F.split("text", r"\s+")).cast("long").alias("words"))


@query("""
WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS w FROM benchmark), q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS d FROM documents WHERE doc_id = 1)
SELECT item_id, round((0.2 * len(list_intersect(w, d)) + 0.4 * len(list_intersect(w, ['the', 'and', 'of'])) + 0.6 * len(list_intersect(w, ['the'])) + 0.6 * len(list_intersect(w, ['in', 'to'])))::DOUBLE, 6) AS overlap FROM t, q
""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted identifier overlap of items with a skill's texts."""
    q = load(spark, sf_dir, "documents").filter("doc_id = 1").select(N.identifiers("text").alias("d")).limit(1)
    t = load(spark, sf_dir, "benchmark").select("item_id", N.identifiers("text").alias("w")).join(F.broadcast(q))
    lit = lambda *x: F.array(*map(F.lit, x))
    return t.select("item_id", F.round(M.lexical_overlap(F.col("w"), F.col("d"), lit("the", "and", "of"), lit("the"), lit("in", "to")), 6).alias("overlap"))


@query("""
SELECT event_id, round(CASE WHEN value > 50 THEN 1.0 ELSE -0.5 END + CASE WHEN event_type = 'view' THEN 0.4 ELSE 0 END + CASE WHEN event_type = 'click' AND value > 50 THEN 0.25 ELSE 0 END
  + CASE WHEN event_type = 'signup' THEN 0.3 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 0.2 ELSE 0 END - 0.05 * (event_id % 4) - least(0.5, user_id / 5000.0::DOUBLE) - least(0.25, value / 20000.0::DOUBLE)
  - CASE WHEN event_type = 'error' THEN 0.4 ELSE 0 END - CASE WHEN user_id % 7 = 0 THEN 0.1 ELSE 0 END, 9) AS score FROM events
""")
def episode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode score of each event."""
    t = F.col("event_type")
    s = M.episode_score(F.col("value") > 50, t == "view", t == "click", t == "signup", t == "purchase", F.col("event_id") % 4 + 1, F.col("user_id"), F.col("value"), t == "error", F.col("user_id") % 7 == 0)
    return load(spark, sf_dir, "events").select("event_id", F.round(s, 9).alias("score"))


@query("""
SELECT p_partkey, round(least(0.35 * (p_size % 5) + 0.75 * ((p_size % 3) / greatest(p_size % 4, 1)::DOUBLE) + 0.4 * greatest(p_retailprice / 3000, 0) + 0.25 * greatest(-(p_size - 25.0) / 50, 0), 2.5), 6) AS positive,
  round(least(0.45 * (p_size % 6) + 0.2 * (p_size % 4) + 0.6 * (p_retailprice / 2000), 3.0), 6) AS negative,
  round(least(0.25 + 0.03 * least(p_size % 8, 5) + 0.04 * least(p_size % 3, 2) + 0.015 * least(p_size, 15), 1.25)::DOUBLE, 6) AS seed_cost,
  round(0.5 + 0.35 * (p_size % 5) - 0.45 * (p_size % 6) + 0.4 * greatest(p_retailprice / 3000, 0) + 0.2 * greatest(-(p_size - 25.0) / 50, 0) + 0.0005 * greatest(-(1000 - p_retailprice), 0) + 0.05 * (p_size % 2), 6) AS distillation,
  greatest(0, p_size % 5 + p_size % 3 - p_size % 4)::BIGINT AS priority, round(p_size / (p_size + 10)::DOUBLE, 9) AS confidence FROM part
""")
def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer, risk, cost, distillation, priority and confidence of each skill."""
    s, price = F.col("p_size"), F.col("p_retailprice")
    first, retry = price / 3000, (s - 25.0) / 50
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(M.positive_transfer(s % 5, s % 3, s % 4, first, retry), 6).alias("positive"),
        F.round(M.negative_risk(s % 6, s % 4, price / 2000), 6).alias("negative"),
        F.round(M.seed_cost(s % 8, s % 3, s), 6).alias("seed_cost"),
        F.round(M.distillation_score(F.lit(0.5), s % 5, s % 6, first, retry, 1000 - price, s % 2), 6).alias("distillation"),
        F.greatest(F.lit(0), s % 5 + s % 3 - s % 4).cast("long").alias("priority"),
        F.round(M.confidence(s), 9).alias("confidence"),
    )


@query("""
SELECT p_partkey, round(greatest(least(1.0::DOUBLE - CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END - CASE WHEN p_size > 40 THEN 0.25 ELSE 0 END - least(0.45, 0.25 * (p_size % 3)) - CASE WHEN p_brand LIKE '%1' THEN 0.15 ELSE 0 END
  - CASE WHEN p_type LIKE '%STEEL' THEN 0.2 ELSE 0 END, 1.2), 0), 6) AS score, list_filter([CASE WHEN p_size % 2 = 0 AND p_size > 30 THEN 'guard_without_evidence' END, CASE WHEN p_type LIKE '%STEEL' THEN 'file_path_without_evidence' END], lambda x: x IS NOT NULL) AS veto FROM part
""")
def compatibility_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility score with veto reasons."""
    s = F.col("p_size")
    steel = F.col("p_type").like("%STEEL")
    score = M.compatibility(s % 2 == 0, s > 40, s % 3, F.col("p_brand").like("%1"), steel)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"), M.reasons(guard_without_evidence=(s % 2 == 0) & (s > 30), file_path_without_evidence=steel).alias("veto"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'percent|%|discount') THEN 'percentage' WHEN regexp_matches(lower(text), 'ways|choose') THEN 'counting' WHEN regexp_matches(lower(text), 'ratio|rate|per ') THEN 'rate_ratio'
  WHEN regexp_matches(lower(text), 'price|cost|hour|day') THEN 'time_money' ELSE 'arithmetic' END AS pattern FROM conversations
""")
def task_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task pattern by the first rule that fits."""
    t = F.lower("text")
    rule = M.first_reason(percentage=t.rlike("percent|%|discount"), counting=t.rlike("ways|choose"), rate_ratio=t.rlike("ratio|rate|per "), time_money=t.rlike("price|cost|hour|day"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(rule, F.lit("arithmetic")).alias("pattern"))


@query("""
SELECT user_id, concat_ws('|', 'code', CASE WHEN e > 0 THEN 'compile_failed' END, CASE WHEN c = 0 THEN 'missing_final' END, CASE WHEN p > 5 THEN 'truncated' END) AS feature_key,
  CASE WHEN p > 5 THEN 'continue' WHEN e > 0 THEN 'repair' WHEN c = 0 THEN 'continue' END AS action FROM (
  SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
""")
def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature keys and recovery actions from public flags."""
    n = lambda t, a: F.count_if(F.col("event_type") == t).alias(a)
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(n("error", "e"), n("click", "c"), n("purchase", "p"))
    no = F.lit(False)
    key = F.concat_ws("|", F.lit("code"), F.when(F.col("e") > 0, "compile_failed"), F.when(F.col("c") == 0, "missing_final"), F.when(F.col("p") > 5, "truncated"))
    return g.select("user_id", key.alias("feature_key"), M.public_action(no, F.col("p") > 5, F.col("e") > 0, no, no, F.col("c") == 0).alias("action"))


@query("""
SELECT page_id, md5(regexp_replace(trim(html), '[\\x00-\\x1f\\x7f]', '', 'g')) AS cleaned FROM pages
""")
def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters stripped."""
    return load(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace(F.trim("html"), r"[\x00-\x1f\x7f]", "")).alias("cleaned"))


@query()
def unescaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with character references decoded by the full table, NFKC-folded."""
    t = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return load(spark, sf_dir, "pages").select("page_id", N.unescape_html(t).alias("title")).withColumn("folded", N.nfkc("title"))
