"""Streaming queries over the events table; the SQL computes from the whole table what the stream has seen at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import policies as P
from ..streaming import usage as U
from .tables import load


@query("""
WITH o AS (SELECT user_id AS key, list(event_type <> 'error' ORDER BY ts, event_id) AS oks FROM events GROUP BY 1)
SELECT key, len(oks) AS calls, len(list_filter(oks, lambda x: x)) AS successes, list_position(list_append(list_reverse(oks), true), true) - 1 AS streak,
  round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(range(1, len(oks) + 1), lambda i: len(list_filter(oks[1:i], lambda x: x)) / i::DOUBLE)), lambda u, e: 0.5 * u + 0.5 * e), 9) AS utility FROM o
""")
def stream_usage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage state of each key after the whole stream; equals the batch fold."""
    U.with_state_store(spark)
    rows = U.run_once(U.usage_states(U.event_stream(spark, f"{sf_dir}/events.parque[t]")), "update")
    last = F.max_by(F.struct("calls", "successes", "streak", "utility"), "batch").alias("s")
    return rows.groupBy("key").agg(last).select("key", "s.calls", "s.successes", "s.streak", F.round("s.utility", 9).alias("utility"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows by type, the last one too."""
    rows = U.run_to_end(spark, f"{sf_dir}/events.parque[t]", U.tumbling)
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 2 HOURS, true)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "start", strftime(max(ts) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, session
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of two hours, the open ones too."""
    rows = U.run_to_end(spark, f"{sf_dir}/events.parque[t]", U.sessions)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("user_id", shown("start"), shown("end"), "n")


def episodes(events: DataFrame) -> DataFrame:
    """Events as episodes: what was tried, with which skill, and how it ended."""
    v, u = F.col("value"), F.col("user_id")
    return events.select(
        F.col("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("b"), u % 3).alias("benchmark"), F.col("event_type").alias("pattern"),
        F.when(u % 7 > 0, F.concat(F.lit("s"), u % 40)).alias("skill"), F.element_at(F.array(F.lit(""), F.lit("x"), F.lit("y")), (F.col("event_id") % 3 + 1).cast("int")).alias("subtype"),
        F.when(v < 20, "pure_dynamic_success").when(v < 45, "seeded_dynamic_success").when(v < 70, "direct_skill_reuse").otherwise("failed").alias("provenance"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 2 == 0, "skill_seeded_dynamic").otherwise("dynamic").alias("mode"), (F.col("event_id") % 5 != 0).alias("reuse"),
        F.when(v > 99.5, "pruned").when(v > 99, "suppressed").otherwise("").alias("status_after"),
    )


EPISODES = """
episodes AS (
  SELECT ts, event_id AS seq, 'b' || (user_id % 3) AS benchmark, event_type AS pattern, CASE WHEN user_id % 7 > 0 THEN 's' || (user_id % 40) END AS skill, ['', 'x', 'y'][event_id % 3 + 1] AS subtype,
    CASE WHEN value < 20 THEN 'pure_dynamic_success' WHEN value < 45 THEN 'seeded_dynamic_success' WHEN value < 70 THEN 'direct_skill_reuse' ELSE 'failed' END AS provenance,
    event_type <> 'error' AS success, CASE WHEN event_id % 2 = 0 THEN 'skill_seeded_dynamic' ELSE 'dynamic' END AS mode, event_id % 5 <> 0 AS reuse,
    CASE WHEN value > 99.5 THEN 'pruned' WHEN value > 99 THEN 'suppressed' ELSE '' END AS status_after
  FROM events
)"""
_KINDS = {
    "fresh": "provenance = 'pure_dynamic_success' AND reuse",
    "seeded": "provenance = 'seeded_dynamic_success'",
    "direct": "provenance = 'direct_skill_reuse' AND success",
    "seed_failed": "mode = 'skill_seeded_dynamic' AND NOT success",
    "suppressed": "status_after = 'suppressed'",
    "pruned": "status_after = 'pruned'",
}


def _steps_sql() -> str:
    rows = []
    for place, (kind, dimension, channel, step, by_subtype, directive) in enumerate(P.RULES):
        for n in range(2 if by_subtype else 1):
            sub, more = ("subtype", " AND subtype <> ''") if n else ("''", "")
            rows.append(f"SELECT ts, seq, {2 * place + n} AS place, '{dimension}' AS dimension, {dimension} AS name, '{channel}' AS channel, {sub} AS subtype, {step}::DOUBLE AS step, '{directive}' AS directive FROM episodes WHERE {_KINDS[kind]} AND {dimension} IS NOT NULL{more}")
    return "steps AS (" + " UNION ALL ".join(rows) + ")"


_DELTAS = f"""WITH {EPISODES}, {_steps_sql()},
folded AS (SELECT dimension, name, channel, subtype, list(step ORDER BY ts, seq, place) AS d FROM steps GROUP BY ALL),
deltas AS (SELECT dimension, name, channel, subtype, list_reduce(list_prepend(0.0::DOUBLE, d), lambda u, x: round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, u + x)), 4)) AS delta FROM folded)"""


@query(_DELTAS + " SELECT * FROM deltas")
def policy_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of benchmarks, task patterns and skills, each also by usage subtype, after all episodes."""
    return P.policy_deltas(P.policy_steps(episodes(load(spark, sf_dir, "events"))))


@query(f"""WITH {EPISODES}, {_steps_sql()},
said AS (SELECT dimension, name, subtype, directive, min((ts, seq, place)) AS came FROM steps WHERE directive <> '' GROUP BY ALL)
SELECT dimension, name, subtype, directive, row_number() OVER (PARTITION BY dimension, name, subtype ORDER BY came) AS place FROM said
""")
def policy_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives of each policy in the order in which they came."""
    return P.policy_directives(P.policy_steps(episodes(load(spark, sf_dir, "events"))))


@query(_DELTAS + """, said AS (SELECT dimension, name, subtype, directive, min((ts, seq, place)) AS came FROM steps WHERE directive <> '' GROUP BY ALL),
lists AS (SELECT dimension, name, subtype, list(directive ORDER BY came) AS directives FROM said GROUP BY ALL)
SELECT d.*, array_to_string(coalesce(directives, []), '; ') AS directives FROM deltas d LEFT JOIN lists USING (dimension, name, subtype)
""")
def stream_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deltas and directives as keyed state of a stream."""
    U.with_state_store(spark)
    steps = P.policy_steps(episodes(U.event_stream(spark, f"{sf_dir}/events.parque[t]")))
    rows = U.run_once(P.policy_stream(steps), "update")
    by = ["dimension", "name", "channel", "subtype"]
    # a directive may come after a delta's last move: the newest list of its subtype counts
    lists = rows.groupBy("dimension", "name", "subtype").agg(F.max_by("directives", F.struct("batch", F.size("directives"))).alias("directives"))
    last = rows.groupBy(*by).agg(F.max_by("delta", "batch").alias("delta"))
    return last.join(lists, ["dimension", "name", "subtype"]).select(*by, "delta", F.array_join("directives", "; ").alias("directives"))


# generator state ----------------------------------------------------------------------------------------------------


def _used(df: DataFrame) -> DataFrame:
    """Episodes with the skills that they used: the selected one and, now and then, another."""
    other = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("s"), F.col("seq") % 40))
    return df.withColumn("used", F.array_compact(F.array("skill", other)))


_USED = EPISODES + """,
used AS (SELECT *, list_filter([skill, CASE WHEN seq % 4 = 0 THEN 's' || (seq % 40) END], lambda x: x IS NOT NULL) AS used FROM episodes),
uses AS (SELECT unnest(list_distinct(used)) AS skill, ts, seq, pattern, status_after, (mode = 'skill_seeded_dynamic')::BIGINT AS seeded, (mode = 'skill_seeded_dynamic' AND success)::BIGINT AS seeded_ok,
  (provenance = 'direct_skill_reuse')::BIGINT AS direct, (provenance = 'direct_skill_reuse' AND success)::BIGINT AS direct_ok FROM used)"""


@query(f"""WITH {_USED},
run AS (SELECT *, sum(seeded) OVER w AS n, sum(seeded_ok) OVER w AS k FROM uses WINDOW w AS (PARTITION BY skill ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
turns AS (SELECT *, CASE WHEN status_after IN ('suppressed', 'pruned') THEN 'suppressed' WHEN n >= 3 AND k / n::DOUBLE > 0.7 THEN 'macro_action' END AS turn FROM run)
SELECT skill, coalesce(arg_max(turn, (ts, seq)) FILTER (turn IS NOT NULL), 'planning_prior') AS role, CASE WHEN bool_or(status_after IN ('suppressed', 'pruned')) THEN 'disabled' ELSE 'soft_hint' END AS insertion,
  round(CASE WHEN sum(direct) > 0 THEN sum(direct_ok) / sum(direct)::DOUBLE ELSE 0 END, 4) AS direct_rate, round(CASE WHEN sum(seeded) > 0 THEN sum(seeded_ok) / sum(seeded)::DOUBLE ELSE 0 END, 4) AS seeded_rate FROM turns GROUP BY 1
""")
def meta_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's action space after all episodes."""
    return P.action_layer(P.skill_uses(_used(episodes(load(spark, sf_dir, "events")))))


@query(f"""WITH {_USED},
g AS (SELECT pattern, list_sort(list_distinct(used)) AS skills, count(*) AS support, arg_min(used, (ts, seq)) AS first FROM used WHERE mode = 'skill_seeded_dynamic' AND success AND len(used) > 0 GROUP BY 1, 2)
SELECT 'motif_' || pattern || '_' || array_to_string(first[1:3], '_') AS motif, pattern, array_to_string(skills, ',') AS skills, support, support >= 3 AS active FROM g
""")
def meta_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow motifs of successful seeded episodes."""
    m = P.motif_layer(_used(episodes(load(spark, sf_dir, "events"))))
    return m.withColumn("skills", F.array_join("skills", ","))


@query(f"""WITH {EPISODES}, steps AS (
  SELECT ts, seq, 0 AS place, 'seeded_delta' AS name, 0.1::DOUBLE AS step FROM episodes WHERE provenance = 'seeded_dynamic_success'
  UNION ALL SELECT ts, seq, 1, 'direct_skill_delta', 0.05 FROM episodes WHERE provenance = 'direct_skill_reuse' AND success
  UNION ALL SELECT ts, seq, 2, 'seeded_delta', -0.1 FROM episodes WHERE mode = 'skill_seeded_dynamic' AND NOT success
), o AS (SELECT name, list(step ORDER BY ts, seq, place) AS d FROM steps GROUP BY 1)
SELECT name, list_reduce(list_prepend(0.0::DOUBLE, d), lambda u, x: round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, u + x)), 4)) AS delta FROM o
""")
def meta_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's routing biases after all episodes."""
    return P.bias_layer(episodes(load(spark, sf_dir, "events")))


@query(f"""WITH {_USED},
cards AS (SELECT skill, min(pattern) AS pattern, round(avg((seeded_ok + direct_ok > 0)::INT::DOUBLE) * 2.4, 6) AS utility, sum(direct_ok) AS direct_ok, sum(direct) AS direct, sum(seeded_ok) AS seeded_ok, sum(seeded) AS seeded,
  sum((pattern = 'purchase')::INT) AS positive, sum((pattern = 'error')::INT) AS negative FROM uses GROUP BY 1),
p AS (SELECT pattern, avg(utility) AS utility, sum(direct_ok)::BIGINT AS direct_ok, sum(direct)::BIGINT AS direct, sum(seeded_ok)::BIGINT AS seeded_ok, sum(seeded)::BIGINT AS seeded, sum(positive) AS positive, sum(negative) AS negative FROM cards GROUP BY 1),
s AS (SELECT *, '[strategy] pattern ''' || pattern || ''': ' AS head FROM p)
SELECT 'prefer skill-conditioned generation for ' || pattern AS directive FROM p WHERE utility > 0.7
UNION ALL SELECT 'avoid ' || skill || ' for seeded generation' FROM cards WHERE negative > positive AND negative > 0
UNION ALL SELECT head || 'direct skill reuse is reliable (' || direct_ok || '/' || direct || ' success)' FROM s WHERE utility >= 0.8 AND direct >= 2 AND direct_ok / direct::DOUBLE >= 0.7
UNION ALL SELECT head || 'avoid seeded generation -- historical seeded success only ' || seeded_ok || '/' || seeded FROM s WHERE seeded >= 3 AND seeded_ok / seeded::DOUBLE < 0.4
UNION ALL SELECT head || 'seeded generation is effective (' || seeded_ok || '/' || seeded || ' success)' FROM s WHERE seeded >= 3 AND seeded_ok / seeded::DOUBLE >= 0.7
UNION ALL SELECT head || 'high negative transfer risk -- consider fresh dynamic generation instead of skill reuse' FROM s WHERE negative >= 3 AND negative > positive
""")
def meta_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives from the bank's statistics by task pattern and skill."""
    e = _used(episodes(load(spark, sf_dir, "events")))
    u = P.skill_uses(e)
    good = (F.col("seeded_ok") + F.col("direct_ok") > 0).cast("double")
    when = lambda p: F.sum((F.col("pattern") == p).cast("long"))
    cards = u.groupBy("skill").agg(F.min("pattern").alias("pattern"), F.round(F.avg(good) * 2.4, 6).alias("utility"), *[F.sum(c).alias(c) for c in ("direct_ok", "direct", "seeded_ok", "seeded")], when("purchase").alias("positive"), when("error").alias("negative"))
    return P.directive_layer(cards, e)
