"""Graph-retrieval queries: chunking, content ids, entity and edge merges, degree, vector hits, budgets and the four contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as N
from ..operators import graph as G
from ..operators import vectors as V
from ..operators.contexts import GLOBAL, LOCAL, Graph
from ..operators.lineage import checkpointed
from .tables import EDGE_SQL, HIT_SQL, entity_hits, graph_edges, load, query_vector


@query("""
SELECT doc_id, i // 100 AS chunk_order_index, len(w[i + 1 : i + 120]) AS tokens,
  'chunk-' || md5(array_to_string(w[i + 1 : i + 120], ' ')) AS chunk_id
FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents))
""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of 120 words, 20 shared with the next, with content ids."""
    chunks = N.chunks(load(spark, sf_dir, "documents"), size=120, overlap=20)
    return chunks.select("doc_id", F.col("chunk_order_index").cast("long").alias("chunk_order_index"), F.col("tokens").cast("long").alias("tokens"), "chunk_id")


@query("SELECT 'doc-' || md5(trim(text)) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_md5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content id; the first one stands for its copies."""
    docs = load(spark, sf_dir, "documents").select("doc_id", N.content_id("text", "doc-").alias("content_id"))
    return docs.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""
SELECT 'doc-' || md5(trim(text)) AS content_id, min(doc_id) AS doc_id FROM documents
WHERE md5(trim(text)) NOT IN (SELECT md5(trim(text)) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1
""")
def new_docs_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that a store (here the even ids) doesn't have yet."""
    docs = load(spark, sf_dir, "documents").select("doc_id", N.content_id("text", "doc-").alias("content_id"))
    store = docs.filter("doc_id % 2 = 0").select("content_id")
    return docs.join(store, "content_id", "left_anti").groupBy("content_id").agg(F.min("doc_id").alias("doc_id"))


@query("""
SELECT doc_id, n_chars, 'store' AS origin FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, n_chars, 'new' FROM documents WHERE doc_id % 3 = 0 AND lang <> 'en'
""")
def upsert_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows stay; incoming rows join only under new keys."""
    from ..operators.relational import insert_missing

    docs = load(spark, sf_dir, "documents")
    store = docs.filter("lang = 'en'").select("doc_id", "n_chars", F.lit("store").alias("origin"))
    return insert_missing(store, docs.filter("doc_id % 3 = 0").select("doc_id", "n_chars", F.lit("new").alias("origin")), ["doc_id"])


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each key: max_by, so partial aggregation does the work before the shuffle."""
    from ..operators.relational import last_version

    ev = load(spark, sf_dir, "events")
    return last_version(ev, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


_MENTION_SQL = """
mentions AS (
  SELECT upper(p_brand) AS name, p_type AS kind, p_name AS description, 'chunk-' || (p_partkey % 97) AS source_id, p_partkey AS seq FROM part
), kinds AS (SELECT name, kind, count(*) AS n, min(seq) AS first FROM mentions GROUP BY name, kind),
best AS (SELECT name, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS r FROM kinds) WHERE r = 1)"""


@query(f"""
WITH {_MENTION_SQL}
SELECT name, kind, (SELECT string_agg(d, '<SEP>' ORDER BY d) FROM (SELECT DISTINCT description AS d FROM mentions m WHERE m.name = best.name)) AS description,
  (SELECT string_agg(s, '<SEP>' ORDER BY s) FROM (SELECT DISTINCT source_id AS s FROM mentions m WHERE m.name = best.name)) AS source_id
FROM best
""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions of parts merged by brand: majority kind, sorted distinct texts and sources."""
    p = load(spark, sf_dir, "part")
    return G.merge_entities(
        p.select(
            F.upper("p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_name").alias("description"),
            F.concat(F.lit("chunk-"), F.col("p_partkey") % 97).alias("source_id"), F.col("p_partkey").alias("seq"),
        )
    )


_EDGE_MENTIONS = """
mentions AS (
  SELECT 'N' || s_nationkey AS x, 'N' || c_nationkey AS y, l_quantity AS weight, l_returnflag AS description, l_linestatus AS keywords, 'o' || (l_orderkey % 7) AS source_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""


@query(f"""
WITH {_EDGE_MENTIONS}
SELECT least(x, y) AS src, greatest(x, y) AS tgt, sum(weight) AS weight, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description,
  string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords) AS keywords, string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id) AS source_id
FROM mentions GROUP BY 1, 2
""")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade mentions between nations merged to undirected edges."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    m = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.merge_edges(
        m.select(
            F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("tgt"), F.col("l_quantity").alias("weight"),
            F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("keywords"), F.concat(F.lit("o"), F.col("l_orderkey") % 7).alias("source_id"),
        )
    )


@query(f"""
WITH {EDGE_SQL}, nodes AS (SELECT 'S#' || s_suppkey AS name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'P#' || p_partkey FROM part WHERE p_size > 10)
SELECT id AS name, 'UNKNOWN' AS kind, min(orders) AS orders FROM (SELECT src AS id, orders FROM edges UNION ALL SELECT tgt, orders FROM edges)
WHERE id NOT IN (SELECT name FROM nodes) GROUP BY id
""")
def implicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge endpoints without a node row become UNKNOWN nodes."""
    edges = graph_edges(spark, sf_dir).select("src", "tgt", F.col("orders").alias("description"), F.lit("").alias("source_id"))
    sup = load(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S#"), "s_suppkey").alias("name"))
    part = load(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("P#"), "p_partkey").alias("name"))
    return G.implicit_nodes(edges, sup.union(part)).select("name", "kind", F.col("description").alias("orders"))


@query(f"WITH {EDGE_SQL} SELECT id, degree FROM degree")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree of every node; loops count twice."""
    return G.degrees(graph_edges(spark, sf_dir))


@query(f"""
WITH {EDGE_SQL} SELECT src, tgt, weight, a.degree + b.degree AS rank FROM edges JOIN degree a ON a.id = src JOIN degree b ON b.id = tgt
""")
def edge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the summed degree of their ends."""
    edges = graph_edges(spark, sf_dir)
    return G.with_edge_rank(edges, G.degrees(edges)).select("src", "tgt", "weight", "rank")


@query(f"WITH {HIT_SQL} SELECT vec_id, similarity FROM hits")
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top 60 at or above 0.2."""
    return V.top_k(load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir))


@query("""
SELECT doc_id, lang, tokens, running FROM (
  SELECT doc_id, lang, tokens, sum(tokens) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running
  FROM (SELECT doc_id, lang, n_chars, len(regexp_split_to_array(text, '\\s+')) AS tokens FROM documents)) WHERE running <= 4000
""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest documents of each language within a budget of 4000 tokens."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", N.word_count("text").cast("long").alias("tokens"))
    return G.budget_prefix(docs, "tokens", [F.col("n_chars"), F.col("doc_id")], 4000, ["lang"], "n_chars").select("doc_id", "lang", "tokens", "running")


@query(f"""
WITH {EDGE_SQL}, {HIT_SQL}
SELECT id, neighbour, weight FROM (SELECT src AS id, tgt AS neighbour, weight FROM edges UNION ALL SELECT tgt, src, weight FROM edges) JOIN seeds USING (id)
""")
def one_hop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the hit entities."""
    return G.neighbours(entity_hits(spark, sf_dir), graph_edges(spark, sf_dir)).select("id", "neighbour", "weight")


@query(f"""
WITH {EDGE_SQL}, {HIT_SQL}
SELECT id, similarity, degree, p_name AS description FROM seeds JOIN degree USING (id) JOIN part ON id = 'P#' || p_partkey
""")
def local_context_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit entities with their rows and degree; hits without either are dropped."""
    part = load(spark, sf_dir, "part").select(F.concat(F.lit("P#"), "p_partkey").alias("id"), F.col("p_name").alias("description"))
    deg = G.degrees(graph_edges(spark, sf_dir))
    return part.join(entity_hits(spark, sf_dir).select("id", "similarity"), "id").join(deg, "id").select("id", "similarity", "degree", "description")


_LOCAL_EDGE_SQL = f"""
WITH {EDGE_SQL}, {HIT_SQL}, ranked AS (
  SELECT src, tgt, weight, a.degree + b.degree AS rank, 20 AS tokens FROM edges JOIN degree a ON a.id = src JOIN degree b ON b.id = tgt
  WHERE src IN (SELECT id FROM seeds) OR tgt IN (SELECT id FROM seeds)
), cut AS (SELECT *, sum(tokens) OVER (ORDER BY rank DESC, weight DESC, src, tgt ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM ranked)
"""


@query(_LOCAL_EDGE_SQL + "SELECT src, tgt, weight, rank, running FROM cut WHERE running <= 4000")
def local_context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the hit entities by (rank, weight), within the token budget."""
    return _local_edges(spark, sf_dir).select("src", "tgt", "weight", "rank", "running")


def _local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph_edges(spark, sf_dir)
    near = G.incident(entity_hits(spark, sf_dir), edges)
    ranked = G.with_edge_rank(near, G.degrees(edges)).withColumn("tokens", F.lit(20))
    order = [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("tgt")]
    # 20 tokens a relation: the budget can't reach past its 200 best, so the window sees no more
    return G.budget_prefix(ranked.orderBy(*order).limit(200), "tokens", order, 4000)


_CHUNK_SQL = f"""
WITH {EDGE_SQL}, {HIT_SQL}, first_seen AS (
  SELECT l_orderkey AS chunk, min(struct_pack(p := -similarity, i := id)) AS f FROM lineitem JOIN seeds ON 'P#' || l_partkey = id GROUP BY 1
), rel AS (
  SELECT f.chunk, f.f.p AS pos, f.f.i AS id, count(DISTINCT n.neighbour) AS relations
  FROM first_seen f JOIN (SELECT src AS id, tgt AS neighbour FROM edges) n ON n.id = f.f.i
  JOIN (SELECT DISTINCT 'S#' || l_suppkey AS s, l_orderkey AS o FROM lineitem) x ON x.o = f.chunk AND x.s = n.neighbour GROUP BY 1, 2, 3
)
"""


@query(_CHUNK_SQL + "SELECT chunk, id, relations FROM rel ORDER BY pos, relations DESC, chunk LIMIT 100")
def local_context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (orders) of the hit entities: first entity that mentions them, relations of that entity in the chunk; best 100."""
    hits = entity_hits(spark, sf_dir)
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("P#"), "l_partkey").alias("id"), F.concat(F.lit("S#"), "l_suppkey").alias("supplier"))
    first = li.join(hits.select("id", "similarity"), "id").groupBy("chunk").agg(F.min(F.struct((-F.col("similarity")).alias("pos"), "id")).alias("f")).select("chunk", "f.pos", "f.id")
    near = G.neighbours(first, graph_edges(spark, sf_dir)).select("id", F.col("neighbour").alias("supplier"))
    in_chunk = li.select("chunk", "supplier").join(first.select("chunk", "id", "pos"), "chunk")
    rel = in_chunk.join(near, ["id", "supplier"]).groupBy("chunk", "id", "pos").agg(F.countDistinct("supplier").alias("relations"))
    return rel.orderBy("pos", F.desc("relations"), "chunk").limit(100).select("chunk", "id", "relations")


@query(f"""
WITH {EDGE_SQL}, {HIT_SQL}, rels AS (
  SELECT src, tgt, weight, similarity, a.degree + b.degree AS rank FROM edges JOIN seeds s ON s.id = src JOIN degree a ON a.id = src JOIN degree b ON b.id = tgt)
SELECT src, tgt, weight, similarity, rank FROM rels ORDER BY rank DESC, weight DESC, src, tgt LIMIT 200
""")
def global_context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation hits with rows and rank, best first, as the global mode starts; at most 200 (20 tokens each of 4000)."""
    edges = graph_edges(spark, sf_dir)
    hits = edges.join(entity_hits(spark, sf_dir).select(F.col("id").alias("src"), "similarity"), "src")
    ranked = G.with_edge_rank(hits, G.degrees(edges))
    return ranked.orderBy(F.desc("rank"), F.desc("weight"), "src", "tgt").limit(200).select("src", "tgt", "weight", "similarity", "rank")


@query(_LOCAL_EDGE_SQL + """
SELECT id, degree, running FROM (
  SELECT id, degree, sum(10) OVER (ORDER BY degree DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running
  FROM (SELECT DISTINCT id FROM (SELECT src AS id FROM cut WHERE running <= 4000 UNION ALL SELECT tgt FROM cut WHERE running <= 4000)) JOIN degree USING (id)
) WHERE running <= 1000
""")
def global_context_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the kept relations as entities by degree, within their budget."""
    rel = _local_edges(spark, sf_dir)
    ends = rel.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    rows = G.degrees(graph_edges(spark, sf_dir)).join(ends, "id").withColumn("tokens", F.lit(10))
    order = [F.desc("degree"), F.col("id")]
    return G.budget_prefix(rows.orderBy(*order).limit(100), "tokens", order, 1000).select("id", "degree", "running")


@query(_LOCAL_EDGE_SQL + """
SELECT l_orderkey AS chunk, min(pos) AS pos FROM lineitem JOIN (
  SELECT src, tgt, row_number() OVER (ORDER BY rank DESC, weight DESC, src, tgt) AS pos FROM cut WHERE running <= 4000
) ON src = 'P#' || l_partkey AND tgt = 'S#' || l_suppkey GROUP BY 1
""")
def global_context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the kept relations by the first relation that names them."""
    kept = _local_edges(spark, sf_dir)  # 20 tokens a row: the running sum is 20 x the position
    rel = kept.select("src", "tgt", (F.col("running") / 20).cast("long").alias("pos"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("P#"), "l_partkey").alias("src"), F.concat(F.lit("S#"), "l_suppkey").alias("tgt"))
    return li.join(rel, ["src", "tgt"]).groupBy("chunk").agg(F.min("pos").alias("pos"))


@query(_LOCAL_EDGE_SQL + """
SELECT DISTINCT line FROM (
  SELECT src || ',' || tgt || ',' || rank AS line FROM cut WHERE running <= 4000
  UNION ALL (SELECT src || ',' || tgt || ',' || (a.degree + b.degree) FROM edges JOIN seeds s ON s.id = src JOIN degree a ON a.id = src JOIN degree b ON b.id = tgt
    ORDER BY a.degree + b.degree DESC, weight DESC, src, tgt LIMIT 200)
)
""")
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the local and global relation sections as distinct lines."""
    line = F.concat_ws(",", "src", "tgt", "rank").alias("line")
    return _local_edges(spark, sf_dir).select(line).union(global_context_relations(spark, sf_dir).select(line)).distinct()


@query(f"""
WITH {HIT_SQL}, c AS (
  SELECT doc_id, text, similarity, len(regexp_split_to_array(text, '\\s+')) AS tokens FROM hits JOIN documents ON vec_id = doc_id)
SELECT doc_id, similarity, running FROM (SELECT *, sum(tokens) OVER (ORDER BY similarity DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c) WHERE running <= 4000
""")
def naive_chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits as chunks in order of similarity, within the budget."""
    hits = V.top_k(load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(hits, F.col("doc_id") == F.col("vec_id")).select("doc_id", "similarity", N.word_count("text").cast("long").alias("tokens"))
    return G.budget_prefix(rows, "tokens", [F.desc("similarity"), F.col("doc_id")], 4000).select("doc_id", "similarity", "running")


def _part(key: str) -> Column:
    """A part as a number among all nodes: even ones are parts, odd ones suppliers. Numbers meet faster than names."""
    return F.col(key).cast("long") * 2


def _name(col: str) -> Column:
    return F.concat(F.when(F.col(col).bitwiseAND(1) == 0, "P#").otherwise("S#"), F.shiftright(col, 1))


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    part = load(spark, sf_dir, "part").select(_part("p_partkey").alias("id"), F.col("p_name").alias("name"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), _part("l_partkey").alias("src"), (F.col("l_suppkey") * 2 + 1).alias("tgt"), F.col("l_quantity").alias("quantity"))
    return Graph(None, part, li, _name)


def _one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    hits = V.nearest(e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), e)
    return checkpointed(hits.select("query_id", ((F.col("id") + 1) * 2).alias("id"), "similarity"))


def _bpe(line: str) -> Column:
    from ..functions.tokens import token_count

    return token_count(line)


@query()
def local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole local context by real token counts."""
    return _graph(spark, sf_dir).sections(_one_query(spark, sf_dir), "local", LOCAL, _bpe).drop("query_id")


@query()
def global_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole global context by real token counts."""
    return _graph(spark, sf_dir).sections(_one_query(spark, sf_dir), "global", GLOBAL, _bpe).drop("query_id")


@query()
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both contexts merged section by section: each line once, the local ones first, in their order."""
    return _graph(spark, sf_dir).both(_one_query(spark, sf_dir), tokens=_bpe).drop("query_id")


#: Every vector as a query: hits by cosine of six digits, 0.2 or more, best 20.
_ALL_HITS = """
unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings),
all_hits AS (
  SELECT query_id, vec_id, similarity FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (q.size * e.size), 6) AS similarity FROM unit q, unit e)
  WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 20
), seeds AS (SELECT query_id, 'P#' || (vec_id + 1) AS id, similarity FROM all_hits)"""
#: Budgets of the contexts of the whole table of queries.
_SMALL, _SMALL_GLOBAL = (400, 120, 200), (200, 120, 200)


def _section_sql(mode: str, budgets: tuple[int, int, int]) -> str:
    """CTEs of one mode: {mode}_relations, {mode}_entities, {mode}_sources over seeds and ranked."""
    count = "len(regexp_extract_all(line, '[A-Za-z0-9]+'))"
    near = "SELECT query_id, src, tgt, weight, rank FROM ranked JOIN seeds ON id = src"
    if mode == "local":
        near += " UNION SELECT query_id, src, tgt, weight, rank FROM ranked JOIN seeds ON id = tgt"
        entities = "SELECT query_id, s.id, -similarity AS spot, degree, p_name FROM seeds s"
    else:
        entities = f"SELECT query_id, s.id, -degree::DOUBLE AS spot, degree, p_name FROM (SELECT query_id, src AS id FROM {mode}_relations UNION SELECT query_id, tgt FROM {mode}_relations) s"
    cut = lambda order, budget: f"SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT *, {count} AS tokens FROM lines) QUALIFY running <= {budget}"
    return f"""
{mode}_relations AS (WITH lines AS (SELECT *, src || ',' || tgt || ',' || weight || ',' || rank AS line FROM ({near})) {cut("rank DESC, weight DESC, src, tgt", budgets[0])}),
{mode}_entities AS (WITH lines AS (SELECT *, id || ',' || p_name || ',' || degree AS line FROM ({entities} JOIN degree d ON d.id = s.id JOIN part ON s.id = 'P#' || p_partkey)) {cut("spot, id", budgets[1])}),
{mode}_sources AS (WITH lines AS (
  SELECT query_id, l_orderkey AS chunk, min(running) AS spot, l_orderkey || ',' || sum(l_quantity) AS line
  FROM lineitem JOIN {mode}_relations ON src = 'P#' || l_partkey AND tgt = 'S#' || l_suppkey GROUP BY 1, 2) {cut("spot, chunk", budgets[2])}),
{mode}_all AS (
  SELECT query_id, 'relations' AS section, line, tokens, running FROM {mode}_relations
  UNION ALL SELECT query_id, 'entities', line, tokens, running FROM {mode}_entities UNION ALL SELECT query_id, 'sources', line, tokens, running FROM {mode}_sources)"""


_RANKED_SQL = "ranked AS (SELECT src, tgt, weight, a.degree + b.degree AS rank FROM edges JOIN degree a ON a.id = src JOIN degree b ON b.id = tgt)"


def _all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return V.nearest(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), e, k=20)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(_all_queries(spark, sf_dir).select("query_id", ((F.col("id") + 1) * 2).alias("id"), "similarity"))


@query(f"WITH {_ALL_HITS} SELECT query_id, vec_id AS id, similarity FROM all_hits")
def vector_topk_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector, all queries in one plan."""
    return _all_queries(spark, sf_dir)


@query(f"WITH {EDGE_SQL}, {_ALL_HITS}, {_RANKED_SQL}, {_section_sql('local', _SMALL)} SELECT * FROM local_all")
def local_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local contexts of a table of queries, by word counts."""
    return _graph(spark, sf_dir).sections(_seeds(spark, sf_dir), "local", _SMALL)


@query(f"WITH {EDGE_SQL}, {_ALL_HITS}, {_RANKED_SQL}, {_section_sql('global', _SMALL_GLOBAL)} SELECT * FROM global_all")
def global_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global contexts of a table of queries, by word counts."""
    return _graph(spark, sf_dir).sections(_seeds(spark, sf_dir), "global", _SMALL_GLOBAL)


@query(f"""
WITH {EDGE_SQL}, {_ALL_HITS}, {_RANKED_SQL}, {_section_sql('local', _SMALL)}, {_section_sql('global', _SMALL_GLOBAL)},
one AS (SELECT query_id, section, line, min(tokens) AS tokens, min(spot) AS spot FROM (
  SELECT *, running AS spot FROM local_all UNION ALL SELECT *, 1000000 + running FROM global_all) GROUP BY 1, 2, 3)
SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY spot) AS place, line, tokens FROM one
""")
def hybrid_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both contexts of a table of queries, merged section by section."""
    return _graph(spark, sf_dir).both(_seeds(spark, sf_dir), _SMALL, _SMALL_GLOBAL)


@query(f"""
WITH {_ALL_HITS}, c AS (SELECT query_id, doc_id, similarity, len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS tokens FROM all_hits JOIN documents ON vec_id = doc_id)
SELECT query_id, doc_id, similarity, sum(tokens) OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c QUALIFY running <= 4000
""")
def naive_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each query's hits in order of similarity, within its budget of words."""
    docs = load(spark, sf_dir, "documents").select("doc_id", N.word_count("text").cast("long").alias("tokens"))
    rows = docs.join(_all_queries(spark, sf_dir), F.col("doc_id") == F.col("id"))
    return G.budget_prefix(rows, "tokens", [F.desc("similarity"), F.col("doc_id")], 4000, ["query_id"]).select("query_id", "doc_id", "similarity", "running")


@query("""
SELECT p_partkey AS key, p_name AS name, ord FROM (SELECT unnest([7, 3, 999999, 12, 3]) AS k, unnest([0, 1, 2, 3, 4]) AS ord) LEFT JOIN part ON p_partkey = k
""")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of keys in its order; missing keys give null fields."""
    from ..operators.relational import lookup

    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return lookup(spark, part, "key", [7, 3, 999999, 12, 3])


@query(f"""
WITH {EDGE_SQL} SELECT src, tgt, src || ' -> ' || tgt AS label FROM (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM edges)
""")
def stable_graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges in stored order, sorted by their label."""
    a, b = G.canonical("src", "tgt")
    e = graph_edges(spark, sf_dir).select(a.alias("src"), b.alias("tgt"))
    return e.withColumn("label", F.concat_ws(" -> ", "src", "tgt")).orderBy("label")


@query(f"""
WITH {EDGE_SQL}, upd AS (SELECT src, tgt, weight + 1000 AS weight FROM edges WHERE weight > 40)
SELECT src, tgt, coalesce(u.weight, e.weight) AS weight FROM edges e LEFT JOIN upd u USING (src, tgt)
""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge attributes overwritten by later versions."""
    from ..operators.relational import last_version

    e = graph_edges(spark, sf_dir).select("src", "tgt", "weight", F.lit(0).alias("seq"))
    upd = e.filter("weight > 40").select("src", "tgt", F.col("weight") + 1000, F.lit(1))
    return last_version(e.union(upd), ["src", "tgt"], ["seq"], ["weight"], n=2 * load(spark, sf_dir, "lineitem").count())


_CC_SQL = """
RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt FROM lineitem),
b AS MATERIALIZED (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e),
cc(id, component) USING KEY (id) AS (
  SELECT DISTINCT src, src FROM b
  UNION SELECT b.tgt, min(c.component) FROM cc c JOIN b ON b.src = c.id JOIN recurring.cc r ON r.id = b.tgt WHERE c.component < r.component GROUP BY 1)
"""


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"))


@query(f"WITH {_CC_SQL} SELECT id, component FROM cc")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the graph of all shipments."""
    return G.connected_components(_shipments(spark, sf_dir))


@query(f"""
WITH {_CC_SQL}, n AS (SELECT component, count(*) AS n FROM cc GROUP BY 1 ORDER BY n DESC, component LIMIT 1)
SELECT id, component FROM cc WHERE component = (SELECT component FROM n)
""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component with most nodes."""
    return G.largest_component(_shipments(spark, sf_dir))


@query("""
SELECT 'entity' AS record, upper(n_name) AS name, 'NATION' AS kind, NULL AS tgt, 'in region ' || n_regionkey AS description, NULL::DOUBLE AS weight FROM nation
UNION ALL SELECT 'relationship', upper(n_name), NULL, upper(r_name), 'lies in', CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 0.5 ELSE 1.0 END FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extraction output of each nation, parsed to entity and relation rows."""
    t = N.FIELD_DELIMITER
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    m = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    weight = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_nationkey", F.lit(".5"))).otherwise(F.lit("strong"))
    entity = F.concat_ws(t, F.lit('("entity"'), "n_name", F.lit("nation"), F.concat(F.lit("in region "), "n_regionkey", F.lit(")")))
    relation = F.concat_ws(t, F.lit('("relationship"'), "n_name", "r_name", F.lit("lies in"), F.lit("place"), F.concat(weight, F.lit(")")))
    raw = m.select("n_nationkey", F.concat(entity, F.lit("##"), relation, F.lit('##("entity"' + t + "short)<END>")).alias("raw"))
    return N.parse_records(raw, "raw").select("record", "name", "kind", "tgt", "description", "weight")
