"""Keyed-store operators: versions, upserts, lookups and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_missing(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Store rows, and incoming rows under keys that the store doesn't have."""
    return store.unionByName(incoming.join(store.select(*keys), keys, "left_anti"))


#: Rows of a task that aggregates under keys of which most have few rows, about.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """rows, n at most, dealt by their keys over so many tasks that each gets about TASK_ROWS; as they are where the session's partitions are as many."""
    tasks = -(-n // TASK_ROWS)
    return rows if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(tasks, *keys)


def last_version(rows: DataFrame, keys: list[str], order: list[str], values: list[str], n: int = 0) -> DataFrame:
    """For each key the values of the row that comes last in order; n: the most rows there are, where keys have few each, so that memory is bounded by more tasks."""
    rows = dealt(rows, n, keys)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def lookup(spark: SparkSession, table: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys in their order with an ord column; missing ones give nulls. The list is a parameter, sent as a
    literal."""
    if not wanted:
        return table.limit(0).withColumn("ord", F.lit(0))
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in wanted])).alias("ord", "_k"))
    return table.join(F.broadcast(ids), F.col(key) == F.col("_k"), "right").select(*table.columns, "ord")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    left = a.select(*keys).distinct().withColumn("_l", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_r", F.lit(True))
    out = left.join(right, keys, "full").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return out.select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def exactly_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a one-row-a-key rule: (keys, n) with n > 1."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def strict_join(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with the columns of labels; a row without a label, or a key with several labels, stops the query with an error."""
    one = labels.groupBy(key).agg(*[F.first(c).alias(c) for c in labels.columns if c != key], F.count(F.lit(1)).alias("_labels"))
    met = rows.join(one, key, "left")
    name = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("_labels").isNull(), F.raise_error(F.concat(name, F.lit(" has no label")))).when(F.col("_labels") > 1, F.raise_error(F.concat(name, F.lit(" has several labels"))))
    # the check yields null where it passes, so it can't be optimised away from the key
    return met.withColumn(key, F.coalesce(checked.cast(met.schema[key].dataType), F.col(key))).drop("_labels")


def after_sealing(submissions: DataFrame, labels: DataFrame, key: str, sealed: Column) -> DataFrame:
    """submissions with their labels, which join only when every submission is sealed; an unsealed one stops the query with an error."""
    open_ones = submissions.agg(F.count_if(~F.coalesce(sealed, F.lit(False))).alias("_open"))
    gate = open_ones.select(F.when(F.col("_open") > 0, F.raise_error(F.lit("labels are read only after all submissions are sealed"))).otherwise(F.lit(0)).alias("_gate"))
    gated = labels.join(F.broadcast(gate)).filter("_gate = 0").drop("_gate")  # one row
    return submissions.join(gated, key, "left")
