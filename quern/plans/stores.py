"""Stores: snapshots, graph files, vector upserts, canaries, banks of strategy cards and votes by equivalent answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scan as X
from ..operators import banks, embedding, votes
from ..operators.canaries import canary_hits
from ..operators.lineage import shared_folder
from ..sources import files
from ..sources.snapshots import Snapshots
from .tables import EDGE_SQL, graph_edges, load


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SENTENCES = """
s AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]+\\s*')) AS t FROM benchmark),
canaries AS (SELECT row_number() OVER (ORDER BY t) AS canary, t FROM (SELECT DISTINCT t FROM s WHERE length(t) >= 12))"""


@query(f"WITH {_SENTENCES} SELECT doc_id, t AS canary FROM documents JOIN canaries ON contains(text, t)")
def canary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the benchmark in every document that holds it, by one automaton."""
    s = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[.!?]+\s*")).alias("t")).filter(F.length("t") >= 12).distinct()
    return canary_hits(load(spark, sf_dir, "documents"), s.withColumn("canary", F.col("t")), "doc_id", "text", "canary", "t")


@query(f"""
WITH {EDGE_SQL} SELECT 'edge' AS kind, src AS id, tgt, weight, NULL AS description FROM edges
UNION ALL SELECT 'node', 'P#' || p_partkey, NULL, NULL, p_name || ' <' || p_brand || '> & "' || p_type || '" part' FROM part
""")
def graphml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph written as GraphML parts and read back in ranges of 64 kB."""
    at = _folder(spark, "graph")
    about = F.concat(F.col("p_name"), F.lit(" <"), F.col("p_brand"), F.lit('> & "'), F.col("p_type"), F.lit('" part'))
    nodes = load(spark, sf_dir, "part").select(F.concat(F.lit("P#"), "p_partkey").alias("id"), F.lit("PART").alias("entity_type"), about.alias("description"))
    files.write_graphml(nodes, graph_edges(spark, sf_dir).select("src", "tgt", "weight"), at)
    n, e = files.read_graphml(spark, at, 1 << 16)
    return e.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), "tgt", "weight", F.lit(None).cast("string").alias("description")).union(n.select(F.lit("node"), "id", F.lit(None), F.lit(None), "description"))


@query("""
WITH one AS (SELECT o_orderkey, o_orderstatus AS status FROM orders),
two AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE o_orderstatus END AS status FROM orders),
three AS (SELECT o_orderkey, status FROM two WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'))
SELECT 1 AS snapshot, status, count(*) AS n FROM one GROUP BY 2 UNION ALL SELECT 2, status, count(*) FROM two GROUP BY 2 UNION ALL SELECT 3, status, count(*) FROM three GROUP BY 2
""")
def registry_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry changed twice, each snapshot read as of its number."""
    s = Snapshots(spark, _folder(spark, "registry"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    large = load(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", F.lit("large").alias("status"))
    low = load(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    s.update(lambda _: o)
    s.update(lambda was: embedding.merged(was, large, "o_orderkey"))
    s.update(lambda was: was.join(low, "o_orderkey", "left_anti"))
    parts = [s.read(n).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("snapshot"), "status", "n") for n in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("""
WITH rows AS (SELECT conv_id AS id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
words AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM rows),
parts AS (SELECT id, ('0x' || md5(w)[1:4])::BIGINT % 16 AS dim, 1 - 2 * (('0x' || md5(w)[5:6])::BIGINT % 2) AS v FROM words),
sums AS (SELECT id, dim, sum(v) AS v FROM parts GROUP BY 1, 2),
sizes AS (SELECT id, sqrt(sum(v * v)) AS size FROM sums GROUP BY 1)
SELECT id, dim, round(v / size, 6) AS value FROM sums JOIN sizes USING (id) WHERE v <> 0
""")
def vector_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put under their conversations' keys in two upserts: the later turn's vector stands."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("content"))
    store = embedding.VectorStore(Snapshots(spark, _folder(spark, "vectors")), embedding.hashed_projection(16))
    store.upsert(c.filter("turn < 1"), "turn")
    store.upsert(c, "turn")
    out = store.read().select("id", F.posexplode("vector").alias("dim", "v")).filter("v <> 0")
    return out.select("id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("value"))


# banks --------------------------------------------------------------------------------------------------------------

_OPS = """
r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS total FROM supplier),
m AS (SELECT s_nationkey, (r + 1) // 2 AS pair, min(n) AS n, max(total) AS total, list('c' || s_suppkey ORDER BY s_suppkey) AS cards, list('f' || (s_suppkey % 5) ORDER BY s_suppkey) AS f FROM r GROUP BY 1, 2 HAVING count(*) = 2),
mm AS (SELECT s_nationkey, (q + 1) // 2 AS pair, min(n) AS n, max(total) AS total, list(card ORDER BY card) AS cards FROM (
  SELECT *, 'm' || n AS card, row_number() OVER (PARTITION BY s_nationkey ORDER BY pair) AS q FROM m) GROUP BY 1, 2 HAVING count(*) = 2)"""


@query(f"""
WITH {_OPS}, births AS (
  SELECT 'c' || s_suppkey AS card, 1 AS version, 0 AS begun, 1 AS sources FROM supplier
  UNION ALL SELECT 'm' || n, 2, n, 2 FROM m UNION ALL SELECT 'mm' || n, 3, total + n, 4 FROM mm UNION ALL SELECT 'x' || n, 2, 2 * total + n, 1 FROM r WHERE s_acctbal > 9000
), moves AS (
  SELECT unnest(cards) AS card, n AS begun, 'retired' AS status FROM m UNION ALL SELECT unnest(cards), total + n, 'retired' FROM mm
  UNION ALL SELECT 'c' || s_suppkey, 2 * total + n, 'quarantine' FROM r WHERE s_acctbal > 9000
  UNION ALL SELECT 'c' || s_suppkey, 3 * total + n, CASE WHEN s_acctbal < 0 THEN 'quarantine' ELSE 'retired' END FROM r WHERE s_acctbal < 1000
), events AS (SELECT card, begun, 'candidate' AS status FROM births UNION ALL SELECT * FROM moves)
SELECT e.card, version, status, sources, e.begun AS valid_from, lead(e.begun) OVER (PARTITION BY e.card ORDER BY e.begun) AS valid_to FROM events e JOIN births b ON b.card = e.card
""")
def bank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of suppliers' cards through merges, merges of merged cards, splits and maintenance: every version with the operations between which it holds."""
    return _bank(spark, sf_dir).select("card", "version", "status", F.size("sources").alias("sources"), "valid_from", "valid_to")


@query(f"""
WITH {_OPS}, total AS (SELECT max(total) AS t FROM r), gone AS (SELECT unnest(cards) AS card FROM m)
SELECT 'candidate' AS status, (SELECT count(*) FROM supplier) - (SELECT count(*) FROM gone) + (SELECT count(*) FROM m) AS n UNION ALL SELECT 'retired', count(*) FROM gone HAVING count(*) > 0
""")
def bank_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's cards by status as it stood after its first merges."""
    n = load(spark, sf_dir, "supplier").count()
    return banks.bank_as_of(_bank(spark, sf_dir), n).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.curation import ranked

    s = load(spark, sf_dir, "supplier")
    part = F.floor(F.col("s_suppkey") / 4096)
    r = ranked(s, ["s_nationkey"], part, [F.col("s_suppkey")]).drop("_size").withColumnRenamed("_r", "r")
    r = ranked(r, [], part, [F.col("s_suppkey")]).withColumnsRenamed({"_r": "n", "_size": "total"})
    card, feature = F.concat(F.lit("c"), "s_suppkey"), F.concat(F.lit("f"), F.col("s_suppkey") % 5)
    m = r.groupBy("s_nationkey", F.floor((F.col("r") + 1) / 2).alias("pair")).agg(F.min("n").alias("n"), F.max("total").alias("total"), F.array_sort(F.collect_list(card)).alias("cards"), F.collect_set(feature).alias("features")).filter("size(cards) = 2")
    q = ranked(m, ["s_nationkey"], F.floor(F.col("pair") / 4096), [F.col("pair")])
    mm = q.groupBy("s_nationkey", F.floor((F.col("_r") + 1) / 2).alias("pair")).agg(F.min("n").alias("n"), F.max("total").alias("total"), F.collect_list(F.concat(F.lit("m"), "n")).alias("cards"), F.array_distinct(F.flatten(F.collect_list("features"))).alias("features")).filter("size(cards) = 2")
    none = {"status": "string", "harmful": "boolean", "saving": "double", "enough": "boolean"}
    empty = [F.lit(None).cast(k).alias(c) for c, k in none.items()]
    merge = lambda df, at, name: df.select(at.alias("at"), F.lit("merge").alias("action"), "cards", F.concat(F.lit(name), "n").alias("into"), "features", *empty)
    split = r.filter("s_acctbal > 9000").select((2 * F.col("total") + F.col("n")).alias("at"), F.lit("split").alias("action"), F.array(card).alias("cards"), F.concat(F.lit("x"), "n").alias("into"), F.array(feature).alias("features"), *empty)
    keep = r.select((3 * F.col("total") + F.col("n")).alias("at"), F.lit("maintain").alias("action"), F.array(card).alias("cards"), F.lit(None).cast("string").alias("into"), F.lit(None).cast("array<string>").alias("features"), F.lit(None).cast("string").alias("status"), (F.col("s_acctbal") < 0).alias("harmful"), (F.col("s_acctbal") - 1000 + F.lit(1e-6)).alias("saving"), F.lit(True).alias("enough"))
    ops = merge(m, F.col("n"), "m").union(merge(mm, F.col("total") + F.col("n"), "mm")).union(split).union(keep)
    cards = s.select(card.alias("card"), F.concat(F.lit("n"), "s_nationkey").alias("subject"), F.array(feature).alias("features"), F.array(card).alias("sources"))
    return banks.bank_history(cards, ops)


# votes and scanners -------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE a AS (SELECT l_orderkey AS k, l_linenumber::BIGINT * 1000000000000 + l_partkey AS c, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
walk AS (
  SELECT k, 1::BIGINT AS i, [v] AS reps, [c] AS firsts, [1::BIGINT] AS sizes FROM a WHERE i = 1
  UNION ALL
  SELECT w.k, a.i, CASE WHEN g IS NULL THEN list_append(reps, v) ELSE reps END, CASE WHEN g IS NULL THEN list_append(firsts, c) ELSE firsts END,
    CASE WHEN g IS NULL THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda n, j: CASE WHEN j = g THEN n + 1 ELSE n END) END
  FROM walk w JOIN a ON a.k = w.k AND a.i = w.i + 1, LATERAL (SELECT list_position(list_transform(w.reps, lambda r: abs(r - a.v) <= 2), true) AS g)
), last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
SELECT k AS l_orderkey, list_max(sizes) AS votes, firsts[list_position(sizes, list_max(sizes))]::BIGINT AS chosen FROM last
""")
def equivalence_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' quantities as candidate answers: those within 2 of a group's first one are equivalent; the largest group's first candidate wins."""
    number = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("candidate"), F.col("l_quantity").cast("string").alias("answer"))
    out = votes.equivalence_votes(li, "l_orderkey", "candidate", "answer", votes.near_numbers(2.0))
    return out.select("l_orderkey", "votes", "chosen")


@query("""
WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || CASE WHEN doc_id % 3 = 0 THEN ' {' WHEN doc_id % 3 = 1 THEN ' $a$' ELSE '' END || chr(10) || chr(10) || 'then \\(x\\)' || chr(10) || ' ' || chr(10) || '}' AS text FROM documents),
cut AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n\\s*\\n') AS parts, regexp_extract_all(text, '\\n\\s*\\n') AS gaps FROM t),
ends AS (SELECT doc_id, text, parts, i, list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda g: length(g))), 0) AS stop FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM cut)),
safe AS (SELECT doc_id, stop, substr(text, 1, stop::BIGINT) AS s FROM ends WHERE trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
SELECT doc_id, count(*) AS boundaries, sum(stop)::BIGINT AS total FROM safe
WHERE length(replace(s, '{', '')) = length(replace(s, '}', '')) AND length(replace(s, '\\[', '')) = length(replace(s, '\\]', '')) AND length(replace(s, '\\(', '')) = length(replace(s, '\\)', ''))
  AND (length(s) - length(replace(s, '$$', ''))) % 4 = 0 AND length(replace(s, '$$', '')) % 2 = length(replace(replace(s, '$$', ''), '$', '')) % 2 GROUP BY 1
""")
def safe_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where whole texts may be cut between paragraphs without cutting a formula."""
    tail = F.when(F.col("doc_id") % 3 == 0, " {").when(F.col("doc_id") % 3 == 1, " $a$").otherwise("")
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), tail, F.lit("\n\nthen \\(x\\)\n \n}"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(X.safe_boundaries(text)).alias("at"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("boundaries"), F.sum("at").alias("total"))


@query("""
WITH t AS (SELECT conv_id, turn, 'So $' || length(text) || '$ and \\[' || replace(text, '$', '') || '\\] give \\boxed{\\frac{' || turn || '}{' || conv_id || '}} of \\$5.' AS t FROM conversations WHERE NOT contains(text, '\\'))
SELECT conv_id, turn, x.kind, x.start, x.value FROM (SELECT conv_id, turn, unnest([
  {'kind': 'maths', 'start': position('$' IN t) - 1, 'value': regexp_extract(t, '\\$([^$]*)\\$', 1)},
  {'kind': 'maths', 'start': position('\\[' IN t) - 1, 'value': t[position('\\[' IN t) + 2 : position('\\]' IN t) - 1]},
  {'kind': 'boxed', 'start': position('\\boxed' IN t) - 1, 'value': '\\frac{' || turn || '}{' || conv_id || '}'}]) AS x FROM t)
""")
def maths_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and maths environments of whole messages, with their places."""
    c = load(spark, sf_dir, "conversations").filter(~F.contains(F.col("text"), F.lit("\\")))
    text = F.concat(F.lit("So $"), F.length("text"), F.lit("$ and \\["), F.replace("text", F.lit("$"), F.lit("")), F.lit("\\] give \\boxed{\\frac{"), "turn", F.lit("}{"), "conv_id", F.lit("}} of \\$5."))
    return c.select("conv_id", "turn", F.explode(X.spans(text)).alias("s")).select("conv_id", "turn", "s.kind", "s.start", "s.value")
