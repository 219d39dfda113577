"""Dataset curation: splits, sampling, near duplicates, contamination and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import curation as C
from ..operators import relational as R
from ..operators.similarity import first_apart, nearest_by_words, similar_texts
from .tables import load


@query("SELECT doc_id, ('0x' || substr(sha256('doc' || doc_id), 1, 8))::BIGINT % 4 AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-way split by the first 32 bits of a digest."""
    return load(spark, sf_dir, "documents").select("doc_id", (C.hash32(F.concat(F.lit("doc"), "doc_id")) % 4).alias("split"))


_GROUP_SQL = "g AS (SELECT lang, source, md5(text) AS grp, count(*) AS n FROM documents GROUP BY 1, 2, 3)"


@query(f"""
WITH {_GROUP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(grp), grp) AS r, count(*) OVER (PARTITION BY lang, source) AS k FROM g)
SELECT lang, source, grp, CASE WHEN k > 1 AND r <= greatest(1, round(0.2 * k)) THEN 'dev' ELSE 'train' END AS split FROM r
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of equal content, a fifth of each (language, source) stratum to dev."""
    g = load(spark, sf_dir, "documents").groupBy("lang", "source", F.md5("text").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return C.stratified_split(g, ["lang", "source"], "grp", 0.2).select("lang", "source", "grp", "split")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('s7' || doc_id), doc_id) <= 100 THEN 'validate' ELSE 'test' END AS split FROM documents
""")
def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle by hash order, the first hundred of each language apart."""
    digest = F.sha2(F.concat(F.lit("s7"), "doc_id"), 256)
    rows = C.ranked(load(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], C.hash_part(digest), [digest, "doc_id"])
    return rows.select("doc_id", F.when(F.col("_r") <= 100, "validate").otherwise("test").alias("split"))


@query("""
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('q' || doc_id)) AS r FROM (
  SELECT min(doc_id) AS doc_id, min(lang) AS lang, min(source) AS source FROM documents GROUP BY md5(text))) WHERE r <= 2
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a stratum after duplicates are one."""
    one = load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    return C.sample_per_stratum(one, ["lang", "source"], F.sha2(F.concat(F.lit("q"), "doc_id"), 256), 2).select("doc_id", "lang")


@query("SELECT doc_id, ('0x' || substr(sha256('task' || doc_id), 1, 8))::BIGINT % 100 < 20 AS holdout FROM documents")
def holdout_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayable 20 % holdout."""
    return load(spark, sf_dir, "documents").select("doc_id", (C.hash32(F.concat(F.lit("task"), "doc_id")) % 100 < 20).alias("holdout"))


@query("""
SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS a, row_number() OVER (PARTITION BY p_type, p_size % 4 ORDER BY p_partkey) AS b FROM part) WHERE a <= 6 AND b <= 2
""")
def novelty_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps of a pattern and of a pattern with arity."""
    p = load(spark, sf_dir, "part").withColumn("arity", F.col("p_size") % 4)
    a, b = Window.partitionBy("p_type").orderBy("p_partkey"), Window.partitionBy("p_type", "arity").orderBy("p_partkey")
    return p.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).filter("a <= 6 AND b <= 2").select("p_partkey")


@query("""
WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, 100 * n / sum(n) OVER ()::DOUBLE AS exact FROM s),
r AS (SELECT lang, floor(exact)::BIGINT AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, lang) AS r, 100 - sum(floor(exact)) OVER () AS rest FROM q)
SELECT lang, base + (r <= rest)::INT AS quota FROM r
""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred places shared out by size, largest remainders first."""
    s = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return C.largest_remainder(s, "lang", "n", 100)


@query("""
SELECT doc_id, lang, band FROM (SELECT doc_id, lang, n_chars // 5000 AS band, row_number() OVER (PARTITION BY lang, n_chars // 5000 ORDER BY sha256('c' || doc_id)) AS r FROM documents) WHERE r = 1
""")
def cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each (language, length band) cell: a min_by, no sort."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 5000).alias("band"))
    return d.groupBy("lang", "band").agg(F.min_by("doc_id", F.sha2(F.concat(F.lit("c"), "doc_id"), 256)).alias("doc_id"))


@query("""
WITH a AS (SELECT 'longest' AS category, doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5),
b AS (SELECT 'shortest' AS category, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars, doc_id LIMIT 5),
c AS (SELECT 'first' AS category, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY doc_id LIMIT 5),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT category, doc_id, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY sha256('d' || doc_id)) <= 3 THEN 'train' ELSE 'dev' END AS split FROM u
""")
def sequential_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories pick five rows each in turn, without replacement; three train, two dev."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    picked = C.pick_in_turn(d, "doc_id", {"longest": [F.desc("n_chars")], "shortest": [F.col("n_chars")], "first": []}, 5)
    w = Window.partitionBy("category").orderBy(F.sha2(F.concat(F.lit("d"), "doc_id"), 256))
    return picked.select("category", "doc_id", F.when(F.row_number().over(w) <= 3, "train").otherwise("dev").alias("split"))


@query("""
WITH a AS (SELECT doc_id, source, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY sha256('p' || doc_id)) AS h FROM documents JOIN labels USING (doc_id))
SELECT x.doc_id, x.quality, y.quality AS shuffled FROM a x JOIN a y ON x.source = y.source AND x.r = y.h
""")
def shuffled_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels permuted within each source."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return C.permuted_within(d, "source", "doc_id", "quality", F.sha2(F.concat(F.lit("p"), "doc_id"), 256))


_MASK = "regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\d+(\\.\\d+)?', '#', 'g')"


@query(f"""
WITH m AS (SELECT doc_id, {_MASK} AS t FROM documents), k AS (SELECT doc_id, 'prefix:' || left(t, 24) AS key FROM m UNION ALL SELECT doc_id, 'suffix:' || right(t, 24) FROM m)
SELECT key, count(*) AS members, min(doc_id) AS first FROM k GROUP BY key HAVING count(*) > 1
""")
def near_dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking keys (24 characters in front and behind) with two members or more."""
    k = C.block_keys(load(spark, sf_dir, "documents"), "doc_id", "text")
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first")).filter("members > 1")


@query()
def near_dup_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and messages, and later versions of the items with a word more, that are near duplicates: blocked pairs verified by the
    matching-blocks ratio (0.9)."""
    items = load(spark, sf_dir, "benchmark").select("item_id", "text")
    a = items.select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    later = items.select(F.concat(F.lit("v"), "item_id").alias("id"), F.concat("text", F.lit(" again")).alias("text"))
    messages = load(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return C.near_duplicate_pairs(a.union(later).union(messages), "id", "text", 0.9)


@query("""
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM benchmark)))
SELECT doc_id, min(item_id) AS item_id, count(DISTINCT item_id) AS items FROM g JOIN b USING (h) GROUP BY 1
""")
def contamination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of an item, wherever they stand in it: joined by the 64-bit hashes of all 8-grams, so
    that no gram travels as text; items under eight words have none."""
    grams = lambda df, key: df.select(key, F.split(F.lower("text"), r"\s+").alias("w")).filter("size(w) >= 8").select(
        key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.slice("w", i, 8))))).alias("h"))
    g, b = grams(load(spark, sf_dir, "documents"), "doc_id"), grams(load(spark, sf_dir, "benchmark"), "item_id")
    return g.join(b, "h").groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("items"))


@query("""
WITH t AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark), p AS (
  SELECT a.item_id, b.item_id AS other, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 9) AS sim FROM t a JOIN t b ON a.item_id <> b.item_id)
SELECT item_id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, other) AS r FROM p WHERE sim >= 0.05) WHERE r = 1
""")
def nearest_exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other item above a cutoff: rare words meet first, and only items without a partner at a high similarity look further."""
    t = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    return nearest_by_words(t, "item_id", "w", 0.05)


@query("""
SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src0') THEN 'removed' ELSE 'kept' END AS fate FROM documents WHERE source <> 'src0'
""")
def independence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows apart from an exposed set, kept and removed."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    seen = d.filter("source = 'src0'").select("h").distinct().withColumn("hit", F.lit(True))
    return d.filter("source <> 'src0'").join(seen, "h", "left").select("doc_id", F.when(F.col("hit"), "removed").otherwise("kept").alias("fate"))


#: Insertion-deletion ratios of all pairs (l, r, x, y: lists of characters) by the rows of the common-subsequence table, as CTE ``scored`` over a CTE ``pr``.
_LCS = """
dp AS (
  SELECT l, r, x, y, 0::BIGINT AS i, list_transform(range(len(y) + 1), lambda j: 0::BIGINT) AS cells FROM pr
  UNION ALL
  SELECT l, r, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j]),
    lambda acc, j: list_append(acc, greatest(cells[j[1] + 1], acc[j[1]], cells[j[1]] + (y[j[1]] = x[i + 1])::BIGINT)), [0::BIGINT]) FROM dp WHERE i < len(x)
), scored AS (SELECT l, r, round(2 * cells[len(y) + 1] / (len(x) + len(y))::DOUBLE, 9) AS ratio FROM dp WHERE i = len(x))"""


@query(f"""
WITH RECURSIVE n AS (SELECT p_name AS t, min(p_partkey) AS k FROM part GROUP BY 1),
pr AS (SELECT a.k AS l, b.k AS r, string_split(a.t, '') AS x, string_split(b.t, '') AS y FROM n a JOIN n b ON a.k < b.k), {_LCS}
SELECT l AS "left", r AS "right", ratio FROM scored WHERE ratio >= 0.9
""")
def lcs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names with an insertion-deletion ratio of 0.9 or more, all of them, by the positional gram index."""
    return similar_texts(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 0.9)


_SUPPLIER_PAIRS = f"""
n AS (SELECT s_name AS t, min(s_suppkey) AS k FROM supplier GROUP BY 1),
pr AS (SELECT a.k AS l, b.k AS r, string_split(a.t, '') AS x, string_split(b.t, '') AS y FROM n a JOIN n b ON a.k < b.k), {_LCS},
alike AS (SELECT l, r FROM scored WHERE ratio >= 0.94)"""


def _alike_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(load(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 0.94).select("left", "right")


@query(f"""
WITH RECURSIVE {_SUPPLIER_PAIRS}, hit AS (SELECT l AS k, r AS other FROM alike UNION ALL SELECT r, l FROM alike)
SELECT s_suppkey, count(other) AS alike, CASE WHEN count(other) > 0 THEN 'removed' ELSE 'kept' END AS fate
FROM supplier s LEFT JOIN (SELECT k, other FROM hit JOIN supplier e ON e.s_suppkey = other WHERE e.s_nationkey % 8 = 0) ON k = s_suppkey WHERE s_nationkey % 8 <> 0 GROUP BY 1
""")
def similarity_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers apart from the exposed ones (every eighth nation): removed where an exposed name is alike (0.94 or more), however few words or
    letters in a row they share; names are unique, so no copies are to be spread to."""
    s = load(spark, sf_dir, "supplier").withColumn("exposed", F.col("s_nationkey") % 8 == 0)
    p = similar_texts(s, "s_suppkey", "s_name", 0.94, across="exposed")
    hit = p.select("left", "right").union(p.select("right", "left")).toDF("s_suppkey", "other").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("alike"))
    n = F.coalesce("alike", F.lit(0).cast("long"))
    return s.filter("not exposed").join(hit, "s_suppkey", "left").select("s_suppkey", n.alias("alike"), F.when(n > 0, "removed").otherwise("kept").alias("fate"))


_WALK = """
nb AS (SELECT k, list(other) AS others FROM (SELECT l AS k, r AS other FROM alike UNION ALL SELECT r, l FROM alike) GROUP BY k),
o AS (SELECT s_suppkey AS k, s_nationkey AS s, coalesce(others, []) AS others, row_number() OVER (ORDER BY s_nationkey, sha256('q' || s_suppkey)) AS place FROM supplier LEFT JOIN nb ON k = s_suppkey),
walk AS (
  SELECT 0::BIGINT AS place, []::BIGINT[] AS chosen, []::BIGINT[] AS strata
  UNION ALL
  SELECT o.place, CASE WHEN ok THEN list_append(chosen, o.k) ELSE chosen END, CASE WHEN ok THEN list_append(strata, o.s::BIGINT) ELSE strata END
  FROM walk w JOIN (SELECT * FROM o) o ON o.place = w.place + 1, LATERAL (SELECT NOT list_has_any(w.chosen, o.others) AND len(list_filter(w.strata, lambda x: x = o.s)) < {quota} AS ok)
)"""


@query(f"WITH RECURSIVE {_SUPPLIER_PAIRS}, {_WALK.format(quota=2)} SELECT s_suppkey, list_contains((SELECT chosen FROM walk ORDER BY place DESC LIMIT 1), s_suppkey) AS chosen FROM supplier")
def quota_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two suppliers a nation in a fixed order, none alike one chosen before in any nation."""
    return first_apart(_supplier_order(spark, sf_dir), _alike_suppliers(spark, sf_dir), 2).withColumnRenamed("key", "s_suppkey")


@query(f"WITH RECURSIVE {_SUPPLIER_PAIRS}, {_WALK.format(quota=1000000)} SELECT s_suppkey, list_contains((SELECT chosen FROM walk ORDER BY place DESC LIMIT 1), s_suppkey) AS chosen FROM supplier")
def greedy_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier in a fixed order unless one chosen before is alike."""
    return first_apart(_supplier_order(spark, sf_dir), _alike_suppliers(spark, sf_dir)).withColumnRenamed("key", "s_suppkey")


def _supplier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("q"), "s_suppkey"), 256)
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", digest.alias("digest"))
    part = F.concat(F.lpad(F.col("s_nationkey").cast("string"), 10, "0"), C.hash_part(F.col("digest")))
    return C.ranked(s, [], part, [F.col("s_nationkey"), F.col("digest")]).select(F.col("s_suppkey").alias("key"), F.col("_r").alias("place"), F.col("s_nationkey").alias("stratum"))


# integrity ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one row."""
    return R.exactly_one(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT count(*) AS orders, sum((n IS NULL)::INT)::BIGINT AS without_lines, (SELECT count(*) FROM lineitem) AS lines, sum(coalesce(n, 0))::BIGINT AS lines_by_order,
  (SELECT count(*) FROM lineitem) = sum(coalesce(n, 0)) AS reconciled FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by row against sums by key."""
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    a = load(spark, sf_dir, "orders").select("o_orderkey").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    left = a.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("n").isNull()).alias("without_lines"), F.sum(F.coalesce("n", F.lit(0))).alias("lines_by_order"))
    whole = n.agg(F.sum("n").alias("lines"))
    return left.join(F.broadcast(whole)).select("orders", "without_lines", "lines", "lines_by_order", (F.col("lines") == F.col("lines_by_order")).alias("reconciled"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT source) = 20 AS comparable FROM documents GROUP BY lang")
def comparable_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each run has the settings that the comparison needs."""
    g = load(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"))
    return g.withColumn("comparable", F.col("sources") == 20)


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS seal, sha256(o_orderkey || '|' || o_custkey || '|' || CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END) AS now FROM orders) WHERE seal <> now
""")
def seal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose recomputed digest differs from their seal."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sealed = o.withColumn("seal", C.seal("o_orderkey", "o_custkey", "o_orderstatus"))
    changed = sealed.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changed.filter(F.col("seal") != C.seal("o_orderkey", "o_custkey", "o_orderstatus")).select("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 'discount_and_tax' END, CASE WHEN l_quantity < 2 THEN 'few' END, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'status' END], lambda x: x IS NOT NULL) AS violations
FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 OR l_quantity < 2 OR l_returnflag = 'N' AND l_linestatus = 'F'
""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break field-level invariants, with the names of the broken ones."""
    from ..functions.scoring import reasons

    c = F.col
    v = reasons(discount_and_tax=(c("l_discount") > 0.09) & (c("l_tax") > 0.07), few=c("l_quantity") < 2, status=(c("l_returnflag") == "N") & (c("l_linestatus") == "F"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("violations")).filter(F.size("violations") > 0)


@query("""
SELECT p_partkey, version, p_size, status FROM (SELECT p_partkey, 1 AS version, p_size, 'active' AS status FROM part UNION ALL SELECT p_partkey, 2, p_size + 1, 'retired' FROM part WHERE p_size > 40)
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY version DESC) = 1
""")
def bank_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current version of each card after a transition."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("version"), "p_size", F.lit("active").alias("status"))
    two = p.filter("p_size > 40").select("p_partkey", F.lit(2), F.col("p_size") + 1, F.lit("retired"))
    return R.last_version(p.union(two), ["p_partkey"], ["version"], ["version", "p_size", "status"], n=2 * p.count())
