"""Rule sets on whole tables; the SQL computes by the same fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import rules as R
from ..functions import tasks as K
from ..functions import text as N
from ..operators import curation as C
from ..operators import graph as G
from .tables import load


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


def _named(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(n)} END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


# questions ----------------------------------------------------------------------------------------------------------

_FEATURES = _named((k, f"regexp_matches(t, {_q(p)})") for k, p in R.FEATURES.items())
_ASKED = """
asked AS (
  SELECT conv_id, turn, lower(text || ['', ' The positive integer remainder modulo 7?', ' What ratio of ways: $\\frac{a}{b}$ per circle', ' solve x^2 + y = 3 for nonzero x', ' P(A) probability, gcd of primes and area'][(conv_id + turn) % 5 + 1]) AS t FROM conversations)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["", " The positive integer remainder modulo 7?", " What ratio of ways: $\\frac{a}{b}$ per circle", " solve x^2 + y = 3 for nonzero x", " P(A) probability, gcd of primes and area"]
    tail = F.element_at(F.array(*map(F.lit, tails)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("q"))


@query(f"""
WITH {_ASKED}, f AS (SELECT conv_id, turn, {_FEATURES} AS features FROM asked),
s AS (SELECT *, [['integer', 'ratio'], ['modular'], ['probability', 'circle'], ['no_such']][conv_id % 4 + 1] AS trigger, [[], ['positive'], ['area']][turn % 3 + 1] AS required, [['nonzero'], []][conv_id % 2 + 1] AS excluded FROM f)
SELECT conv_id, turn, features, conv_id % 4 <> 3 AND list_has_any(trigger, features) AND list_has_all(features, required) AND NOT list_has_any(excluded, features) AS fits FROM s
""")
def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of whole messages with questions behind them, and whether a skill fits: unknown names never do."""
    pick = lambda lists, by: F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), (by + 1).cast("int"))
    f = _asked(spark, sf_dir).withColumn("features", R.question_features("q"))
    trigger = pick([["integer", "ratio"], ["modular"], ["probability", "circle"], ["no_such"]], F.col("conv_id") % 4)
    fits = R.skill_matches(F.col("features"), trigger, pick([[], ["positive"], ["area"]], F.col("turn") % 3), pick([["nonzero"], []], F.col("conv_id") % 2))
    return f.select("conv_id", "turn", "features", fits.alias("fits"))


_DECLARED = ["", " Geometry ", "intermediate_algebra", "Counting & Probability", "counting and probability", "calculus", "PRECALCULUS"]
_HITS = _named((s, _any("t", words)) for s, words in R.SUBJECT_WORDS.items())


@query(f"""
WITH {_ASKED}, g AS (SELECT conv_id, turn, t, replace(lower(trim({_list(_DECLARED)}[conv_id % 7 + 1])), '_', ' ') AS given FROM asked),
h AS (SELECT conv_id, turn, {_HITS} AS hits, CASE WHEN given IN ('counting & probability', 'counting and probability') THEN 'counting_probability' WHEN replace(given, ' ', '_') IN ({", ".join(map(_q, R.SUBJECTS))}) THEN replace(given, ' ', '_') END AS alias FROM g)
SELECT conv_id, turn, coalesce(alias, CASE WHEN len(hits) = 1 THEN hits[1] END) AS subject, CASE WHEN alias IS NOT NULL THEN 'metadata' WHEN len(hits) = 1 THEN 'rule' ELSE 'unknown' END AS source FROM h
""")
def subject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of messages: declared under any spelling, else by the only rule that fits."""
    declared = F.element_at(F.array(*map(F.lit, _DECLARED)), (F.col("conv_id") % 7 + 1).cast("int"))
    subject, source = R.subject_of(declared, "q")
    return _asked(spark, sf_dir).select("conv_id", "turn", subject.alias("subject"), source.alias("source"))


_ENTRIES = ["solve", "sort_items", "count_all", "area_of", "find_it", "run"]
_WORDS = "CASE " + " ".join(f"WHEN {_any('t', w)} THEN {_q(n)}" for n, w in R.WORD_PROBLEMS) + " ELSE 'gsm8k_arithmetic' END"


def _begins(names) -> str:
    return "(" + " OR ".join(f"starts_with(e, {_q(n)})" for n in names) + ")"


@query(f"""
WITH made AS (
  SELECT p_partkey, ['humaneval', 'gsm8k', 'mbpp', 'mbpp'][p_partkey % 4 + 1] AS b, {_list(_ENTRIES)}[p_partkey % 6 + 1] AS e, p_size % 3 AS kind, p_size % 2 AS two,
    'Make a ' || p_name || [' at a discount', ' in 3 hours', ' of some volume', '', ' that is valid'][p_size % 5 + 1] AS prompt FROM part
), tests AS (
  SELECT *, 'assert ' || e || '(' || p_partkey || CASE WHEN two = 1 THEN ', 2' ELSE '' END || ') == ' || CASE kind WHEN 0 THEN 'True' WHEN 1 THEN '4.5' ELSE '[1]' END AS test FROM made
), low AS (SELECT *, lower(prompt || chr(10) || test) AS t FROM tests)
SELECT p_partkey, CASE WHEN b = 'humaneval' THEN 'function_synthesis' WHEN b = 'gsm8k' THEN {_WORDS}
  WHEN {_any('t', R.SORTING)} OR starts_with(e, 'sort') THEN 'sort' WHEN {_any('t', R.COUNTING)} OR starts_with(e, 'count') THEN 'count'
  WHEN kind = 0 THEN CASE WHEN two = 0 THEN 'scalar_guard_predicate' ELSE 'multiarg_relation_or_classifier' END
  WHEN kind = 1 AND ({_any('t', R.FORMULA)} OR {_begins(R.FORMULA_NAMES)}) THEN CASE WHEN two = 0 THEN 'numeric_formula_single_arg' ELSE 'numeric_formula_multi_arg' END
  WHEN {_any('t', R.SEARCHING)} OR starts_with(e, 'find') THEN 'predicate_or_search' ELSE 'mbpp_general' END AS pattern FROM low
""")
def task_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of tasks by their words, names and assertions."""
    at = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    k, s = F.col("p_partkey"), F.col("p_size")
    entry = at(_ENTRIES, k % 6)
    prompt = F.concat(F.lit("Make a "), "p_name", at([" at a discount", " in 3 hours", " of some volume", "", " that is valid"], s % 5))
    test = F.concat(F.lit("assert "), entry, F.lit("("), k.cast("string"), F.when(s % 2 == 1, ", 2").otherwise(""), F.lit(") == "), at(["True", "4.5", "[1]"], s % 3))
    return load(spark, sf_dir, "part").select(k, R.task_pattern(at(["humaneval", "gsm8k", "mbpp", "mbpp"], k % 4), prompt, entry, test).alias("pattern"))


# units --------------------------------------------------------------------------------------------------------------

_ALIASES = sorted(R.unit_table())
_UNIT_ROWS = ", ".join(f"({_q(a)}, {_q(u)}, {_q(d)}, {z!r}::DOUBLE)" for a, (u, d, z) in sorted(R.unit_table().items()))
_N_ALIASES = len(_ALIASES)


@query(f"""
WITH alias(alias, unit, dimension, size) AS (VALUES {_UNIT_ROWS}),
said AS (SELECT l_orderkey * 100 + l_linenumber AS k, max(l_quantity::BIGINT) AS n, max(l_partkey) AS p FROM lineitem GROUP BY 1),
made AS (SELECT k, p, n || ['', ' ', '\\', 'x'][p % 4 + 1] || (SELECT list(alias ORDER BY alias COLLATE "C") FROM alias)[k % {_N_ALIASES} + 1] || ['', ' more', ' LESS '][n % 3 + 1] AS text FROM said),
bare AS (SELECT k, nullif(lower(regexp_extract(trim(regexp_replace(text, '\\s*\\^\\s*', '^', 'g')), '(?i)\\s(less|more)$', 1)), '') AS direction, trim(regexp_replace(trim(regexp_replace(text, '\\s*\\^\\s*', '^', 'g')), '(?i)\\s+(less|more)$', '')) AS t FROM made),
ends AS (SELECT k, t, unnest(range(2, length(t) + 1)) AS i FROM bare),
hits AS (SELECT k, i, unit, dimension, size, trim(substr(t, 1, i::BIGINT - 1)) AS value FROM ends JOIN alias ON alias = lower(substr(t, i::BIGINT)) WHERE NOT regexp_matches(substr(t, i::BIGINT - 1, 1), '[\\p{{L}}\\\\]') AND trim(substr(t, 1, i::BIGINT - 1)) <> ''),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1)
SELECT b.k, coalesce(h.value, b.t) AS value, unit, dimension, round(size, 9) AS size, direction FROM bare b LEFT JOIN best h USING (k)
""")
def unit_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with every spelling of every unit, close to words and signs that hide it."""
    said = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k")).agg(F.max(F.col("l_quantity").cast("long")).alias("n"), F.max("l_partkey").alias("p"))
    at = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    text = F.concat(F.col("n").cast("string"), at(["", " ", "\\", "x"], F.col("p") % 4), at(_ALIASES, F.col("k") % _N_ALIASES), at(["", " more", " LESS "], F.col("n") % 3))
    out = R.units_of(said.select("k", text.alias("t")), "k", "t")
    return out.select("k", "value", "unit", "dimension", F.round("size", 9).alias("size"), "direction")


# skills, goals, planner ---------------------------------------------------------------------------------------------

_SAID = ["fix the file path", "pretty json of words", "validate the csv directory", "a verifier of lists", "sum of digits in rows", "plain", "check each number"]
_AFF = "list_concat(CASE WHEN regexp_matches(t, {p}) THEN ['file_path', 'io'] ELSE [] END, {rest})"


@query(f"""
WITH s AS (SELECT p_partkey, lower({_list(_SAID)}[p_partkey % 7 + 1] || ' ' || p_name) AS t, p_size % 5 = 0 AS direct, p_retailprice / 1000 AS risk, CASE WHEN p_size % 3 > 0 THEN p_type END AS family FROM part),
r AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN {_q(r)}" for r, p in R.ROLES.items())} ELSE 'solver' END AS role,
  list_concat(CASE WHEN regexp_matches(t, {_q(R.AFFORDANCES["file_path"])}) THEN ['file_path', 'io'] ELSE [] END, {_named((a, f"regexp_matches(t, {_q(p)})") for a, p in R.AFFORDANCES.items() if a != "file_path")}) AS affordances FROM s)
SELECT p_partkey, role, affordances, CASE role WHEN 'verifier' THEN 'verifier_only' WHEN 'formatter' THEN 'soft_hint' WHEN 'guard' THEN 'local_guard' ELSE CASE WHEN direct THEN 'hard_skeleton' ELSE 'soft_hint' END END AS mode,
  CASE WHEN role = 'guard' AND list_contains(affordances, 'io') OR risk >= 1.25 THEN 'high' WHEN risk >= 0.55 THEN 'medium' ELSE 'low' END AS risk_label,
  CASE WHEN role = 'guard' AND list_contains(affordances, 'io') THEN 'file_path_guard' WHEN role IN ('guard', 'verifier') THEN coalesce(family, 'generic') || '_' || role ELSE coalesce(family, 'generic_solver') END AS skill_family FROM r
""")
def skill_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, affordances, insertion modes, risk labels and families of skills."""
    said = F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit(" "), "p_name")
    m = R.skill_metadata(said, F.lit(False), F.col("p_size") % 5 == 0, F.col("p_retailprice") / 1000, F.when(F.col("p_size") % 3 > 0, F.col("p_type")))
    return load(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in m.items()])


_NOUNS = ["knives", "leaves", "batteries", "boxes", "glass", "pillows", "mug", "wolves"]
_GOALS = ["Put two hot {} in the cabinet.", "examine some {} with the desklamp", "heat a {} and put it on the shelf", "find two {}", "clean the {} in drawer .", "go on"]


@query(f"""
WITH n AS (SELECT p_partkey, {_list(_NOUNS)}[p_partkey % 8 + 1] AS noun, p_size % 6 AS g, p_size % 2 = 0 AS seen, p_size FROM part),
t AS (SELECT *, replace({_list(_GOALS)}[g + 1], '{{}}', noun) AS goal, CASE g WHEN 0 THEN 'the' WHEN 2 THEN 'shelf' WHEN 4 THEN 'drawer' END AS place,
  CASE WHEN length(noun) < 3 THEN noun WHEN noun LIKE '%ives' THEN left(noun, -3) || 'fe' WHEN noun LIKE '%ves' THEN left(noun, -3) || 'f' WHEN noun LIKE '%ies' THEN left(noun, -3) || 'y'
    WHEN noun LIKE '%ses' OR noun LIKE '%xes' OR noun LIKE '%zes' THEN left(noun, -2) WHEN noun LIKE '%ss' THEN noun WHEN noun LIKE '%s' THEN left(noun, -1) ELSE noun END AS one FROM n)
SELECT p_partkey, CASE WHEN g = 5 THEN '' ELSE one END AS object,
  CASE g WHEN 0 THEN 'cabinet 1' WHEN 2 THEN CASE WHEN seen THEN 'shelf ' || p_size ELSE 'shelf 1' END WHEN 4 THEN CASE WHEN seen THEN 'drawer ' || p_size ELSE 'drawer 1' END ELSE '' END AS target
FROM (SELECT * REPLACE (CASE WHEN g = 0 THEN 0 ELSE g END AS g) FROM t)
""")
def goal_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and places of goals, in the singular and by the first command that goes there."""
    at = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    noun, s = at(_NOUNS, F.col("p_partkey") % 8), F.col("p_size")
    goal = F.replace(at([g.replace("in the cabinet", "in cabinet") for g in _GOALS], s % 6), F.lit("{}"), noun)
    n = s.cast("string")
    commands = F.when(s % 2 == 0, F.array(F.lit("look"), F.concat(F.lit("go to shelf "), n), F.concat(F.lit("go to drawer "), n), F.lit("go to shelf 99"))).otherwise(F.array(F.lit("take mug 1 from shelf 2")))
    obj, target = R.goal_of(goal, commands)
    return load(spark, sf_dir, "part").select("p_partkey", obj.alias("object"), target.alias("target"))


_GATE = """CASE WHEN gate AND veto IS NOT NULL THEN list_concat(list_transform(veto, lambda v: 'planner_veto:' || v), CASE WHEN coalesce(fit, 0) < 0.55 THEN ['{reason}'] ELSE [] END) ELSE [] END"""
_CANDIDATES = """
c AS (SELECT p_partkey, p_size % 10 / 2.0::DOUBLE AS score, p_size % 4 * 0.6::DOUBLE AS compat, p_size % 3 = 0 AS exact, p_size % 5 = 0 AS signature, p_partkey % 2 = 0 AS eligible, p_partkey % 11 = 0 AS abstain,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['guard_without_evidence'] ELSE ['guard_without_evidence', 'path'] END AS veto, CASE WHEN p_partkey % 7 > 0 THEN p_size % 10 / 10.0::DOUBLE END AS fit, p_size % 2 = 0 AS gate,
  p_partkey % 13 = 0 AS filtered, p_partkey % 3 = 0 AS soft_only, p_partkey % 17 = 0 AS soft_first, p_partkey % 9 = 0 AS mismatch, ['no_seed', 'guard_only_seed', 'skeleton_only_seed', 'code_excerpt_seed'][p_size % 4 + 1] AS mode, p_partkey % 19 = 0 AS off FROM part)"""


@query(f"""
WITH {_CANDIDATES}
SELECT p_partkey, list_concat({_named((("below_direct_threshold", "score < 2.5"), ("direct_compat_below_threshold", "compat < 1.5"), ("missing_direct_signature_compatibility", "NOT (exact OR signature)"), ("direct_not_eligible", "NOT eligible"), ("selector_low_confidence_abstain", "abstain")))},
    {_GATE.format(reason="planner_compatibility_below_direct_threshold")}) AS direct,
  CASE WHEN off THEN ['skill_seeded_disabled'] ELSE list_concat(list_concat({_named((("below_seed_threshold", "score < 1.5"), ("seed_compat_below_threshold", "compat < 0.5"), ("selector_low_confidence_abstain", "abstain")))}, {_GATE.format(reason="planner_compatibility_below_seed_threshold")}),
    {_named((("hard_filter_failed", "filtered"), ("planner_compatibility_soft_hint_only", "veto IS NOT NULL AND mode IN ('skeleton_only_seed', 'code_excerpt_seed') AND soft_only"), ("soft_aware_prefers_hint_only", "soft_first AND mode IN ('skeleton_only_seed', 'code_excerpt_seed')"), ("seed_type_profile_mismatch", "mismatch"), ("transfer_utility_below_threshold", "mode = 'no_seed'")))}) END AS seed FROM c
""")
def planner_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates are neither executed nor used as seeds."""
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    veto = F.when(k % 4 == 1, none).when(k % 4 == 2, F.array(F.lit("guard_without_evidence"))).when(k % 4 == 3, F.array(F.lit("guard_without_evidence"), F.lit("path")))
    fit, gate, score, compat, abstain = F.when(k % 7 > 0, (s % 10) / 10.0), s % 2 == 0, (s % 10) / 2.0, (s % 4) * 0.6, k % 11 == 0
    mode = F.element_at(F.array(*map(F.lit, ["no_seed", "guard_only_seed", "skeleton_only_seed", "code_excerpt_seed"])), (s % 4 + 1).cast("int"))
    direct = R.direct_rejections(score, 2.5, compat, s % 3 == 0, s % 5 == 0, k % 2 == 0, abstain, veto, fit, gate)
    seed = R.seed_rejections(k % 19 == 0, score, 1.5, compat, abstain, veto, fit, gate, k % 13 == 0, k % 3 == 0, k % 17 == 0, k % 9 == 0, mode)
    return load(spark, sf_dir, "part").select("p_partkey", direct.alias("direct"), seed.alias("seed"))


# grading and reports ------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, min(l_quantity::BIGINT % 9 + 1) AS a, min(l_partkey % 9 + 1) AS b, min(l_suppkey % 9 + 1) AS c, min(l_linenumber % 9 + 1)::BIGINT AS d FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE (a + b) % 3 WHEN 0 THEN a * b + c * d = 24 WHEN 1 THEN (a + b) * (c - d) = 24 ELSE false END AS solved FROM p
""")
def game_of_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions over each line's four numbers; one in three uses a number twice and never counts."""
    p = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("long") % 9 + 1).alias("a"), F.min(F.col("l_partkey") % 9 + 1).alias("b"), F.min(F.col("l_suppkey") % 9 + 1).alias("c"), F.min((F.col("l_linenumber") % 9 + 1).cast("long")).alias("d"))
    made = lambda *x: F.concat(*[F.lit(v) if v in "+-*/() " or len(v) > 1 else F.col(v).cast("string") for v in x])
    kind = (F.col("a") + F.col("b")) % 3
    text = F.when(kind == 0, made("a", "*", "b", "+", "c", "*", "d", " = 24")).when(kind == 1, made("(", "a", "+", "b", ")", "*", "(", "c", "-", "d", ")")).otherwise(F.concat(F.lit("24*"), F.col("a").cast("string"), F.lit("/"), F.col("a").cast("string")))
    return p.select("l_orderkey", "l_linenumber", R.makes_24(text, F.array("a", "b", "c", "d")).alias("solved"))


@query("""
WITH a AS (SELECT conv_id, turn, ['Yes', ' no ', '(B)', 'B.', 'maybe'][(conv_id + turn) % 5 + 1] AS said, ['0', '1', 'b'][conv_id % 3 + 1] AS gold FROM conversations)
SELECT conv_id, turn, (CASE lower(trim(said)) WHEN 'yes' THEN '0' WHEN 'no' THEN '1' WHEN '(b)' THEN 'b' WHEN 'b.' THEN 'b' ELSE lower(trim(said)) END = gold)::DOUBLE AS score FROM a
""")
def yes_no_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with yes and no as option numbers, by exact match."""
    at = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    said = at(["Yes", " no ", "(B)", "B.", "maybe"], (F.col("conv_id") + F.col("turn")) % 5)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (R.yes_no_label(said) == at(["0", "1", "b"], F.col("conv_id") % 3)).cast("double").alias("score"))


@query("""
WITH a AS (SELECT p_partkey, p_name || '|' || p_brand || ' ' || p_name || '| ' AS gold, p_name || ' ' || p_name || '|' || p_type AS said FROM part),
x AS (SELECT p_partkey, g, s, string_split(trim(lower(g)), ' ') AS u, string_split(trim(lower(replace(s, '#', ''))), ' ') AS v FROM (SELECT p_partkey, unnest(string_split(gold, '|')) AS g, said FROM a), LATERAL (SELECT unnest(string_split(said, '|')) AS s) WHERE trim(g) <> ''),
y AS (SELECT p_partkey, u, v, list_transform(u, lambda w: replace(w, '#', '')) AS uu FROM x),
f AS (SELECT p_partkey, 2.0 * list_sum(list_transform(list_distinct(uu), lambda w: least(len(list_filter(uu, lambda z: z = w)), len(list_filter(v, lambda z: z = w))))) / (len(uu) + len(v)) AS f1 FROM y)
SELECT p_partkey, round(max(f1), 9) AS f1 FROM f GROUP BY 1
""")
def best_part_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best multiset F1 over alternatives and parts of an answer."""
    gold, said = F.concat("p_name", F.lit("|"), "p_brand", F.lit(" "), "p_name", F.lit("| ")), F.concat("p_name", F.lit(" "), "p_name", F.lit("|"), "p_type")
    x = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(gold, r"\|")).alias("g"), said.alias("s")).filter("trim(g) <> ''").select("p_partkey", "g", F.explode(F.split("s", r"\|")).alias("s"))
    u, v = F.split(N.qa_normalize("g"), " "), F.split(N.qa_normalize("s"), " ")
    w = x.select("p_partkey", u.alias("u"), v.alias("v"))
    count = lambda c, t: F.size(F.filter(c, lambda z: z == t))
    same = F.aggregate(F.transform(F.array_distinct("u"), lambda t: F.least(count(F.col("u"), t), count(F.col("v"), t))), F.lit(0), lambda a, b: a + b)
    return w.groupBy("p_partkey").agg(F.round(F.max(2.0 * same / (F.size("u") + F.size("v"))), 9).alias("f1"))


@query("""
WITH v AS (SELECT o_orderkey AS k, o_orderstatus AS legacy FROM orders), f AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END AS fixed FROM orders), n AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS newest, o_orderpriority AS branch FROM orders)
SELECT branch, legacy, fixed, newest, count(*) AS records FROM v JOIN f USING (k) JOIN n USING (k) GROUP BY ALL
""")
def grader_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of three graders over the same records, counted by branch and transition; unknown verdicts are their own."""
    o = load(spark, sf_dir, "orders")
    legacy = o.select("o_orderkey", F.col("o_orderstatus").alias("legacy"))
    fixed = o.select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "F").otherwise(F.col("o_orderstatus")).alias("fixed"))
    newest = o.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("newest"), F.col("o_orderpriority").alias("branch"))
    return legacy.join(fixed, "o_orderkey").join(newest, "o_orderkey").groupBy("branch", "legacy", "fixed", "newest").agg(F.count(F.lit(1)).alias("records"))


@query("""
WITH t AS (SELECT event_type AS branch, unnest([{'g': 'value', 'x': value}, {'g': 'user', 'x': user_id::DOUBLE}, {'g': 'hour', 'x': hour(ts)::DOUBLE}]) AS m FROM events)
SELECT branch, m.g AS evaluator, count(*) AS records, round(sum(m.x), 4) AS total, round(median(m.x), 6) AS median, round(avg(m.x), 6) AS mean FROM t GROUP BY 1, 2
""")
def timing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, sums, medians and means of every measure of a branch."""
    from ..functions.stats import percentiles

    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("branch"), "value", F.col("user_id").cast("double").alias("user"), F.hour("ts").cast("double").alias("hour"))
    long = e.unpivot(["branch"], ["value", "user", "hour"], "evaluator", "x")
    sums = long.groupBy("branch", "evaluator").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("x"), 4).alias("total"), F.round(F.avg("x"), 6).alias("mean"))
    mid = percentiles(long, ["branch", "evaluator"], "x", [0.5]).select("branch", "evaluator", F.round("p50", 6).alias("median"))
    return sums.join(mid, ["branch", "evaluator"])


@query("""
WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), q AS (SELECT *, 40 * n / sum(n) OVER (PARTITION BY lang)::DOUBLE AS exact FROM s),
r AS (SELECT lang, source, floor(exact)::BIGINT AS base, row_number() OVER (PARTITION BY lang ORDER BY exact - floor(exact) DESC, source) AS r, 40 - sum(floor(exact)) OVER (PARTITION BY lang) AS rest FROM q)
SELECT lang, source, base + (r <= rest)::INT AS quota FROM r
""")
def balanced_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of places for every language, shared out inside each by largest remainder."""
    s = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return C.largest_remainder(s, "source", "n", 40, by=["lang"])


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text[1:40]) ORDER BY doc_id) = 1")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first declared row of each task (source) and digest of the prefix."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.left("text", F.lit(40)), 256).alias("h"))
    return d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("""
WITH e AS (SELECT round(CASE WHEN value > 50 THEN 1.0 ELSE -0.5 END + CASE WHEN event_type = 'view' THEN 0.4 ELSE 0 END + CASE WHEN event_type = 'click' AND value > 50 THEN 0.25 ELSE 0 END
  + CASE WHEN event_type = 'signup' THEN 0.3 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 0.2 ELSE 0 END - 0.05 * (event_id % 4) - least(0.5, user_id / 5000.0::DOUBLE) - least(0.25, value / 20000.0::DOUBLE)
  - CASE WHEN event_type = 'error' THEN 0.4 ELSE 0 END - CASE WHEN user_id % 7 = 0 THEN 0.1 ELSE 0 END, 9) AS s, event_id FROM events)
SELECT event_id, floor(s * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS score, floor(greatest(-1.0, least(1.0, s * 1.5)) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS clamped FROM e
""")
def rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode scores, and scores clamped to one, to four places."""
    from .answers import episode_scores

    s = episode_scores(spark, sf_dir)
    return s.select("event_id", R.four(F.col("score")).alias("score"), R.four(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") * 1.5))).alias("clamped"))


@query(r"""
WITH a AS (SELECT conv_id, turn, ['say \boxed{' || turn || '} then \boxed{\frac{' || conv_id || '}{2}} so', 'First it is 3.5. Then it ends! At last ' || conv_id || ' ', '', 'no end'][(conv_id + turn) % 4 + 1] AS t FROM conversations)
SELECT conv_id, turn, ['\frac{' || conv_id || '}{2}', 'At last ' || conv_id, '', 'no end'][(conv_id + turn) % 4 + 1] AS answer,
  ((conv_id + turn) % 4 = 0 AND conv_id % 2 = 0)::DOUBLE AS exact FROM a
""")
def boxed_or_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last box, nested once, else the last sentence; scored by the exact scorer of the registry."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    made = F.array(F.concat(F.lit("say \\boxed{"), t, F.lit("} then \\boxed{\\frac{"), c, F.lit("}{2}} so")), F.concat(F.lit("First it is 3.5. Then it ends! At last "), c, F.lit(" ")), F.lit(""), F.lit("no end"))
    text = F.element_at(made, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    answer = load(spark, sf_dir, "conversations").select("conv_id", "turn", N.boxed_nested_last(text).alias("answer"))
    gold = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\\frac{"), "conv_id", F.lit("}{2}"))).otherwise(F.lit("none"))
    return answer.select("conv_id", "turn", "answer", K.SCORERS["exact"](F.col("answer"), gold).alias("exact"))


# graphs -------------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT s_nationkey AS n, s_suppkey AS s FROM supplier), c AS (SELECT n, count(*) + 1 AS nodes, least(min('N&' || n), min(' s&' || s || ' ')) AS least FROM e GROUP BY 1),
best AS (SELECT n FROM (SELECT n, nodes, min(label) AS first FROM (SELECT c.n, nodes, unnest([' n&amp;' || c.n, ' s&amp;' || e.s || ' ']) AS label FROM c JOIN e USING (n)) GROUP BY 1, 2) ORDER BY nodes DESC, first LIMIT 1)
SELECT 'N&' || n AS src, 'S&' || s AS tgt FROM e WHERE n = (SELECT n FROM best)
""")
def stable_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the largest component of the whole supplier and nation graph, nodes relabelled in upper case without blanks and references, in stored order."""
    e = load(spark, sf_dir, "supplier").select(F.concat(F.lit(" n&amp;"), "s_nationkey").alias("src"), F.concat(F.lit(" s&amp;"), "s_suppkey", F.lit(" ")).alias("tgt"))
    return G.stable_component(e)
