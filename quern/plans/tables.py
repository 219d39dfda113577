"""Table loading and derived tables shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The part-supplier graph of lineitem: an undirected edge a pair, weight = shipped quantity.
EDGE_SQL = """
edges AS (
  SELECT 'P#' || l_partkey AS src, 'S#' || l_suppkey AS tgt, sum(l_quantity) AS weight, count(DISTINCT l_orderkey) AS orders
  FROM lineitem GROUP BY l_partkey, l_suppkey
), degree AS (
  SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY id
)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import dealt

    li = load(spark, sf_dir, "lineitem")
    # most pairs have a row or two: adding up where they are read would hold them all and save nothing
    return (
        dealt(li.select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey"), li.count(), ["l_partkey", "l_suppkey"])
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("weight"), F.countDistinct("l_orderkey").alias("orders"))
        .select(F.concat(F.lit("P#"), "l_partkey").alias("src"), F.concat(F.lit("S#"), "l_suppkey").alias("tgt"), "weight", "orders")
    )


#: Entity hits of a query vector: vec_id 0 against all, cosine >= 0.2, best 60; vector i stands for part i + 1.
HIT_SQL = """
q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
sims AS (
  SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
    / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qe, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity
  FROM embeddings, q
), hits AS (
  SELECT vec_id, similarity FROM sims WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 60
), seeds AS (SELECT 'P#' || (vec_id + 1) AS id, similarity FROM hits)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row's vector (a parameter of the query)."""
    row = load(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import top_k

    hits = top_k(load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir))
    return hits.select(F.concat(F.lit("P#"), (F.col("vec_id") + 1)).alias("id"), "similarity", "vec_id")
