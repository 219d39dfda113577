"""Task text, grading and store queries that complete the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as M
from ..functions import tasks as K
from ..operators import relational as R
from .tables import load


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'active' ELSE 'shadow' END AS status FROM part WHERE p_size % 3 = 0 OR p_size % 3 = 1 AND p_brand LIKE '%1'")
def visible_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active cards, and shadow ones where the flag is set."""
    status = F.when(F.col("p_size") % 3 == 0, "active").when(F.col("p_size") % 3 == 1, "shadow").otherwise("draft")
    flag = F.col("p_brand").like("%1")
    return load(spark, sf_dir, "part").select("p_partkey", status.alias("status"), flag.alias("f")).filter("status = 'active' OR status = 'shadow' AND f").drop("f")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND user_id % 5 <> 0 AND NOT (props IS NULL)")
def trace_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that learning may use."""
    ok = (F.col("event_type") != "error") & F.col("value").isNotNull() & (F.col("user_id") % 5 != 0) & F.col("props").isNotNull()
    return load(spark, sf_dir, "events").filter(ok).select("event_id")


@query("""
SELECT user_id, list_filter([CASE WHEN errors > 3 THEN 'many_errors' END, CASE WHEN errors = n THEN 'no_success' END, CASE WHEN n < 3 THEN 'thin_evidence' END], lambda x: x IS NOT NULL) AS warnings
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
""")
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings derived from usage."""
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.select("user_id", M.reasons(many_errors=F.col("e") > 3, no_success=F.col("e") == F.col("n"), thin_evidence=F.col("n") < 3).alias("warnings"))


@query("""
SELECT o_orderpriority AS state, max(n) FILTER (b = 'F') AS f, max(n) FILTER (b = 'O') AS o, max(n) FILTER (b = 'P') AS p FROM (
  SELECT o_orderpriority, o_orderstatus AS b, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1
""")
def scored_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way join of states, branches and grades, pivoted by branch."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    li = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    p = j.groupBy(F.col("o_orderpriority").alias("state")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("state", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key an allow list has."""
    c = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("""
SELECT CASE WHEN user_id % 2 = 0 THEN 'guided' ELSE 'holdout' END AS mode, event_type, count(*) AS n, sum((value > 50)::INT)::BIGINT AS passed FROM events GROUP BY 1, 2
""")
def mode_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided and holdout runs by type."""
    mode = F.when(F.col("user_id") % 2 == 0, "guided").otherwise("holdout").alias("mode")
    return load(spark, sf_dir, "events").groupBy(mode, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("passed"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 3")
def top_for_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cards to audit by use and utility."""
    p = load(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey", "p_size", "p_retailprice")
    return p.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(3)


@query("""
SELECT p_brand, p_name AS program FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_name), p_name) AS r FROM part GROUP BY 1, 2) WHERE r = 1
""")
def program_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, then length, then spelling."""
    g = load(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("p_name", F.struct((-F.col("n")).alias("a"), F.length("p_name").alias("b"), "p_name")).alias("program")
    return g.groupBy("p_brand").agg(best)


@query("""
SELECT p_type, p_partkey, adjusted, abstain FROM (SELECT p_type, p_partkey, adjusted, max(adjusted) OVER (PARTITION BY p_type) < 1500 AS abstain, row_number() OVER (PARTITION BY p_type ORDER BY adjusted DESC, p_partkey) AS r FROM (
  SELECT p_type, p_partkey, floor(p_retailprice / 10)::BIGINT * 10 + CASE WHEN p_size < 10 THEN 50 WHEN p_size > 40 THEN -50 ELSE 0 END AS adjusted FROM part)) WHERE r = 1
""")
def selector_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties normalised to tens, bonus and penalty, best of each type, abstention below a floor."""
    s = F.col("p_size")
    a = (F.floor(F.col("p_retailprice") / 10) * 10 + F.when(s < 10, 50).when(s > 40, -50).otherwise(0)).alias("adjusted")
    g = load(spark, sf_dir, "part").select("p_type", "p_partkey", a).groupBy("p_type").agg(F.max_by(F.struct("p_partkey", "adjusted"), F.struct("adjusted", -F.col("p_partkey"))).alias("b"))
    return g.select("p_type", "b.p_partkey", "b.adjusted", (F.col("b.adjusted") < 1500).alias("abstain"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN p_size * 60.0::DOUBLE WHEN 2 THEN p_size * 0.01::DOUBLE ELSE p_size::DOUBLE END AS value, (['m', 's', 'usd', NULL])[1 + (p_partkey % 4)::INT] AS unit FROM part
""")
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units in canonical form."""
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' km') WHEN 1 THEN concat(p_size, 'minutes') WHEN 2 THEN concat(p_size, ' cents') ELSE cast(p_size AS string) END")
    value, unit = K.unit_split(raw)
    return load(spark, sf_dir, "part").select("p_partkey", value.alias("value"), unit.alias("unit"))


@query("""
SELECT n_nationkey, 'f_' || n_nationkey AS entry, (n_nationkey % 3)::INT AS arity, CASE n_nationkey % 3 WHEN 0 THEN 'geometry' WHEN 1 THEN 'number_theory' END AS subject FROM nation
""")
def task_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry point, arity and subject of made tasks."""
    k = F.col("n_nationkey").cast("string")
    prompt = F.concat(F.lit("def helper(x):\ndef f_"), k, F.lit("(a):"))
    args = F.expr("CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '1, 2' END")
    test = F.concat(F.lit("assert f_"), k, F.lit("("), args, F.lit(") == 3"))
    given = F.expr("CASE n_nationkey % 3 WHEN 0 THEN ' Geometry ' ELSE 'other' END")
    asked = F.expr("CASE n_nationkey % 3 WHEN 1 THEN 'the Remainder of' ELSE 'a triangle of prime side' END")
    return load(spark, sf_dir, "nation").select("n_nationkey", K.entry_point(prompt, test).alias("entry"), K.arity(test).alias("arity"), K.subject(given, asked).alias("subject"))


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), k AS (SELECT doc_id, parts, list_filter(range(1, len(parts) + 1), lambda i: trim(parts[i]) <> '') AS own FROM p)
SELECT doc_id, len(own) AS paragraphs, coalesce(list_sum(list_transform(parts[1:list_last(own) - 1], lambda x: length(x) + 1)), 0)::BIGINT * (len(own) > 0)::INT + CASE WHEN len(own) = 0 THEN NULL ELSE 0 END AS last_start FROM k
""")
def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of whole texts, and where the last one begins; null without one."""
    d = load(spark, sf_dir, "documents").select("doc_id", K.paragraphs("text").alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.try_element_at("p", F.lit(-1))["start"].cast("long").alias("last_start"))


@query("""
WITH s AS (SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_custkey) AS seal, o_orderstatus AS was, CASE WHEN o_custkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS now, o_custkey FROM orders WHERE o_orderkey % 8 <> 3 OR o_custkey % 2 = 0)
SELECT o.o_orderkey, CASE WHEN seal IS NULL THEN 'unsealed' WHEN seal = sha256(o.o_orderkey || '|' || CASE WHEN o.o_custkey % 6 = 0 THEN 'X' ELSE o.o_orderstatus END || '|' || o.o_custkey) THEN 'sealed' ELSE 'changed' END AS state
FROM orders o LEFT JOIN s USING (o_orderkey)
""")
def stored_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals written when submissions came, against the submissions as they are now: changed rows and rows without a seal are told apart, so labels join neither."""
    import uuid

    from ..operators.curation import seal
    from ..operators.lineage import shared_folder
    from ..sources.snapshots import Snapshots

    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    book = Snapshots(spark, f"{shared_folder(spark)}/seals-{uuid.uuid4().hex}")
    book.write(o.filter("o_orderkey % 8 <> 3 OR o_custkey % 2 = 0").select("o_orderkey", seal("o_orderkey", "o_orderstatus", "o_custkey").alias("seal")))
    now = o.withColumn("o_orderstatus", F.when(F.col("o_custkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")))
    state = F.when(F.col("seal").isNull(), "unsealed").when(F.col("seal") == seal("o_orderkey", "o_orderstatus", "o_custkey"), "sealed").otherwise("changed")
    return now.join(book.read(), "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'take' ELSE 'go' END AS verb, CASE WHEN n_nationkey % 2 = 0 THEN 'apple ' || n_nationkey END AS object, CASE WHEN n_nationkey % 2 = 0 THEN 'desk' END AS place,
  CASE WHEN n_nationkey % 2 = 0 THEN 'mug' ELSE 'egg' END AS goal_object, CASE WHEN n_nationkey % 2 = 0 THEN 'shelf' ELSE 'plate' END AS goal_target FROM nation
""")
def action_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs, objects, places and goal parameters."""
    action = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN concat('take apple ', n_nationkey, ' from desk ', n_nationkey) ELSE 'go to shelf 3' END")
    goal = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'Put a mug on the shelf.' ELSE 'heat some egg and put it on a plate' END")
    verb, obj, place = K.action_parts(action)
    o, t = K.goal_parameters(goal)
    return load(spark, sf_dir, "nation").select("n_nationkey", verb.alias("verb"), obj.alias("object"), K.base_name(place).alias("place"), o.alias("goal_object"), t.alias("goal_target"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'repair' WHEN 1 THEN 'guard' WHEN 2 THEN 'verifier' ELSE 'solver' END AS role, CASE n_nationkey % 4 WHEN 1 THEN 'local_guard' WHEN 2 THEN 'verifier_only' ELSE 'soft_hint' END AS mode,
  CASE n_nationkey % 4 WHEN 0 THEN n_nationkey || '' WHEN 1 THEN '1200' WHEN 2 THEN '45' ELSE 'x' END AS value FROM nation
""")
def roles_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill roles, and units stripped where the question asks for them."""
    said = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'Fix the input' WHEN 1 THEN 'Validate paths' WHEN 2 THEN 'run a unit test' ELSE 'adds' END")
    value = F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat(n_nationkey, '%') WHEN 1 THEN '$1,200 dollars' WHEN 2 THEN '45°' ELSE ' x ' END")
    asked = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'What percent?' WHEN 1 THEN 'How many dollars?' WHEN 2 THEN 'angle in degrees' ELSE 'which' END")
    role, mode = K.skill_role(said)
    return load(spark, sf_dir, "nation").select("n_nationkey", role.alias("role"), mode.alias("mode"), K.strip_asked_units(value, asked).alias("value"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL WHEN 3 THEN true END AS verdict FROM part
""")
def graded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued grades: right, wrong, unknown."""
    p = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.0') WHEN 1 THEN '1' WHEN 2 THEN NULL WHEN 3 THEN '(B)' ELSE 'some long text' END")
    r = F.expr("CASE p_partkey % 5 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN 'b' ELSE 'another text' END")
    return load(spark, sf_dir, "part").select("p_partkey", K.verdict(p, r).alias("verdict"))


@query("SELECT p_partkey, p_size + p_partkey % 7 AS value FROM part")
def operation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic steps of traces as rows."""
    t = load(spark, sf_dir, "part").select("p_partkey", F.expr("concat('first ', p_size, ' + ', p_partkey % 7, ' = ', p_size + p_partkey % 7, ' done')").alias("t"))
    return K.operation_rows(t, "p_partkey", "t").select("p_partkey", F.col("result").cast("long").alias("value"))


@query("""
SELECT p_partkey, CASE WHEN 2 * (p_size + 1) % 3 = 0 THEN (2 * (p_size + 1) // 3)::VARCHAR ELSE 2 * (p_size + 1) || '/3' END AS value, NULL::VARCHAR AS refused,
  '{"args": [' || p_size || ', [1, 2]], "expected": ' || (p_size + 1) || '}' AS literals FROM part
""")
def safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions checked exactly without evaluating code, and literals of assertions."""
    e = F.expr("concat('(', p_size, ' + 1) * 2 / 3')")
    a = F.expr("concat('assert f(', p_size, ', [1, 2]) == ', p_size + 1)")
    return load(spark, sf_dir, "part").select("p_partkey", K.arithmetic(e).alias("value"), K.arithmetic(F.lit("__import__('os')")).alias("refused"), K.assert_literals(a).alias("literals"))


@query("""
SELECT a.n_nationkey, 'go to ? ' || CASE WHEN a.n_regionkey = b.n_regionkey THEN a.n_regionkey::VARCHAR ELSE '?' END AS pattern FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1
""")
def generalised_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common pattern of neighbouring traces."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", F.lit("go to"), "n_name", "n_regionkey").alias("t"))
    b = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("t").alias("u"))
    return n.join(b, "n_nationkey").select("n_nationkey", K.anti_unify("t", "u").alias("pattern"))


@query("SELECT conv_id, turn, substr(sha256(role || '|' || coalesce(text, '')), 1, 16) AS digest, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS cue FROM conversations")
def message_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen-digit digests and cue counts of messages."""
    d = F.substring(F.sha2(F.concat_ws("|", "role", F.coalesce("text", F.lit(""))), 256), 1, 16)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", d.alias("digest"), F.regexp_count(F.lower("text"), F.lit("the")).cast("long").alias("cue"))


@query("SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def stored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines and nested CSV cells written to the shared folder and read back."""
    import uuid

    from ..operators.lineage import shared_folder
    from ..sources import files

    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    files.write_json(load(spark, sf_dir, "region"), f"{root}/region")
    files.write_csv(load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")), f"{root}/nation")
    a = files.read_jsonl(spark, f"{root}/region", "r_regionkey int, r_name string")
    b = spark.read.schema("n_regionkey int, names string").csv(f"{root}/nation", header=True, escape='"')
    n = b.select("n_regionkey", F.size(F.from_json("names", "array<string>")).cast("long").alias("n"))
    return a.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n")


@query("""
SELECT o_orderkey, status FROM (SELECT o_orderkey, o_orderstatus AS status, 0 AS seq FROM orders UNION ALL SELECT o_orderkey, 'late', 1 FROM orders WHERE o_orderkey % 9 = 0) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1
""")
def registry_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows replaced by later ones under the same key."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("seq"))
    late = o.filter("o_orderkey % 9 = 0").select("o_orderkey", F.lit("late"), F.lit(1))
    return R.last_version(o.union(late), ["o_orderkey"], ["seq"], ["status"], n=2 * o.count())


@query("""
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1
""")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn of each conversation (min_by: no sort)."""
    c = load(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f")).select("conv_id", "f.turn", "f.text")


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN (p_size + 1)::VARCHAR WHEN 3 THEN 'line ' || p_size WHEN 4 THEN NULL ELSE '7' END AS answer,
  CASE p_partkey % 6 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'box' WHEN 2 THEN 'marker' WHEN 3 THEN 'last_line' WHEN 4 THEN 'incomplete' ELSE 'marker' END AS source FROM part
""")
def visible_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that responses show, with where they were found."""
    k = F.expr("p_partkey % 6")
    s, more = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    lit = F.lit
    text = (
        F.when(k == 0, F.concat(lit("The answer is "), s))
        .when(k == 1, F.concat(lit("The answer is 5 \nso \\boxed{ "), s, lit(" }")))
        .when(k == 2, F.concat(lit("\\boxed{"), s, lit("} wait\nfinal answer: "), more))
        .when(k == 3, F.concat(lit("some work\nline "), s, lit("\n \n")))
        .when(k == 4, lit("<think> hidden 4"))
        .otherwise(lit("<think>the answer is 3</think>Thus $7$"))
    )
    answer, source = K.visible_answer(text, F.when(k == 0, "length").otherwise("stop"))
    return load(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), source.alias("source"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'integer' WHEN 2 THEN 'base_numeral' WHEN 3 THEN 'choice' ELSE 'number' END AS kind FROM nation
""")
def answer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of answers that questions ask for."""
    q = F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'What percent of it?' WHEN 1 THEN 'How many are there?' WHEN 2 THEN 'Write 5 in base 2' WHEN 3 THEN 'Which of the following' ELSE 'Find x' END")
    return load(spark, sf_dir, "nation").select("n_nationkey", K.answer_spec(q).alias("kind"))


@query("""
SELECT p_partkey, position, CASE position WHEN 1 THEN '3' ELSE p_size::VARCHAR END AS candidate, CASE WHEN p_size = 3 THEN 3 WHEN position = 1 THEN 1 ELSE 2 END AS occurrences FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS position)
""")
def candidate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate answers of a reasoning text with their repetitions."""
    t = F.concat(F.lit("try \\boxed{"), F.col("p_size").cast("string"), F.lit(".0} then result is 3\nso the answer is "), F.col("p_size").cast("string"))
    return K.candidate_events(load(spark, sf_dir, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")


@query("""
SELECT p_partkey, '["(' || p_size || ', [1, 2])", "{a, b}", "x"]' AS parts, NULL::VARCHAR AS "open" FROM part
""")
def bracketed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuple and set answers split outside brackets."""
    t = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", [1, 2]), {a, b}, x"))
    return load(spark, sf_dir, "part").select("p_partkey", K.top_level_parts(t).alias("parts"), K.top_level_parts(F.lit("(a, b")).alias("open"))


@query("""
WITH p AS (SELECT source, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS a, CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 0 END AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (NOT a AND b) AS losses, count(*) FILTER (a IS NULL OR b IS NULL) AS unknown,
  CASE WHEN count(*) FILTER (a IS NULL OR b IS NULL) = 0 THEN round(100.0::DOUBLE * (count(*) FILTER (a AND NOT b) - count(*) FILTER (NOT a AND b)) / count(*), 9) END AS delta_pp FROM p GROUP BY 1
""")
def paired_with_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired wins and losses; one unknown verdict leaves the difference unknown."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("wins"), F.count_if(~a & b).alias("losses"), F.count_if(a.isNull() | b.isNull()).alias("unknown"))
    return g.withColumn("delta_pp", F.when(F.col("unknown") == 0, F.round(100.0 * (F.col("wins") - F.col("losses")) / F.col("n"), 9)))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'other_run' WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'open' END AS state FROM orders
""")
def resume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records against a run's identity: records of another identity are rejected, those of this one are done."""
    ident = lambda c: F.sha2(F.concat_ws("|", F.lit("config"), c), 256)
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    stored = o.filter("o_orderkey % 3 = 0 OR o_orderkey % 20 = 0").select("o_orderkey", ident(F.when(F.col("o_orderkey") % 20 == 0, "other").otherwise("this")).alias("identity"))
    state = F.when(F.col("identity").isNull(), "open").when(F.col("identity") == ident(F.lit("this")), "done").otherwise("other_run")
    return o.join(stored, "o_orderkey", "left").select("o_orderkey", state.alias("state"))
