"""Property-graph storage and retrieval as tables.

nodes: (id, kind, description, source_ids array<string>); edges: (src, tgt, weight, description, keywords, source_ids),
undirected, one row a pair with src < tgt (or src = tgt for a loop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "<SEP>"


def canonical(src: Column | str, tgt: Column | str) -> tuple[Column, Column]:
    """The pair in its stored order."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (src, tgt))
    return F.least(a, b), F.greatest(a, b)


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Entity mentions (name, kind, description, source_id, seq) to one row a name: the most frequent kind (ties: first seen),
    sorted distinct descriptions and sources joined by SEP."""
    kinds = mentions.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = kinds.groupBy("name").agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), "first")).alias("kind"))
    joined = mentions.groupBy("name").agg(_join("description").alias("description"), _join("source_id").alias("source_id"))
    return best.join(joined, "name")


def _join(col: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), SEP)


def merge_edges(mentions: DataFrame) -> DataFrame:
    """Edge mentions (src, tgt, weight, description, keywords, source_id) to one row an undirected pair: summed weight,
    sorted distinct texts and sources joined by SEP."""
    a, b = canonical("src", "tgt")
    return (
        mentions.withColumns({"_a": a, "_b": b})
        .groupBy(F.col("_a").alias("src"), F.col("_b").alias("tgt"))
        .agg(F.sum("weight").alias("weight"), _join("description").alias("description"), _join("keywords").alias("keywords"), _join("source_id").alias("source_id"))
    )


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that no node row names, as nodes of kind UNKNOWN."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("name"), "description", "source_id")
    missing = ends.join(nodes.select("name"), "name", "left_anti")
    return missing.groupBy("name").agg(F.lit("UNKNOWN").alias("kind"), F.min("description").alias("description"), F.min("source_id").alias("source_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): a loop counts twice."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_edge_rank(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """edges with rank = degree of both ends together."""
    s = degree.select(F.col("id").alias("src"), F.col("degree").alias("_s"))
    t = degree.select(F.col("id").alias("tgt"), F.col("degree").alias("_t"))
    return edges.join(s, "src").join(t, "tgt").withColumn("rank", F.col("_s") + F.col("_t")).drop("_s", "_t")


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbour, weight) of each seed id, one hop."""
    both = edges.select(F.col("src").alias("id"), F.col("tgt").alias("neighbour"), "weight").union(
        edges.filter("src <> tgt").select(F.col("tgt"), F.col("src"), "weight")
    )
    return both.join(seeds.select("id").distinct(), "id")


def incident(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with at least one end among the seeds, each once."""
    ids = seeds.select("id").distinct()
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "tgt")
    b = edges.join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select("src", "tgt")
    return edges.join(a.union(b).distinct(), ["src", "tgt"])


def budget_prefix(rows: DataFrame, tokens: str, order: list[Column], budget: int, by: list[str] | None = None, coarse: str | None = None) -> DataFrame:
    """Rows in order while the running sum of tokens (0 or more each) stays within the budget; the first overflow ends the prefix.

    Without groups the window has one partition: callers cut the rows to the most that the budget can hold before. With groups and
    coarse, the column that leads the order (ascending), the tokens of its values are summed first and only rows whose values begin within the
    budget reach the window, so a group of any size is never sorted whole."""
    if by and coarse:
        sums = rows.groupBy(*by, coarse).agg(F.sum(tokens).alias("_t"))
        begins = F.sum("_t").over(Window.partitionBy(*by).orderBy(coarse)) - F.col("_t")
        within = sums.withColumn("_b", begins).filter(F.col("_b") <= budget).select(*[F.col(c).alias(f"_of_{c}") for c in (*by, coarse)])
        same = F.lit(True)
        for c in (*by, coarse):
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        rows = rows.join(within, same, "left_semi")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(w)).filter(F.col("running") <= budget)


#: Rows and bytes of edges that a task reduces to a forest at once.
FOREST, FOREST_BYTES = 1 << 20, 64 << 20


def forest(edges: DataFrame) -> DataFrame:
    """(src, tgt) with the same components: of every FOREST rows that a task reads a star around the smallest node of each of their components, a row a node.
    Null ends take no part."""
    kind = edges.select("src").union(edges.select("tgt")).schema["src"].dataType
    rows = edges.select(F.col("src").cast(kind).alias("src"), F.col("tgt").cast(kind).alias("tgt")).filter("src is not null and tgt is not null")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def stars(held):
            ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks().dictionary_encode()
            names, n = ends.dictionary, len(ends) // 2
            order = pc.sort_indices(names)
            rank = np.empty(len(names), np.int64)
            rank[order.to_numpy()] = np.arange(len(names))
            ids = rank[ends.indices.to_numpy()]
            u, v, low = ids[:n], ids[n:], np.arange(len(names))
            while len(u):
                a, b = low[u], low[v]
                apart = a != b
                u, v, a, b = u[apart], v[apart], a[apart], b[apart]
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
                while (low[low] != low).any():
                    low = low[low]
            names = names.take(order)
            for lo in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([names.slice(lo, 1 << 16), names.take(pa.array(low[lo : lo + (1 << 16)]))], ["src", "tgt"])

        held, n, size = [], 0, 0
        for b in batches:
            held, n, size = [*held, b], n + len(b), size + b.nbytes
            if n >= FOREST or size >= FOREST_BYTES:
                yield from stars(held)
                held, n, size = [], 0, 0
        if n:
            yield from stars(held)

    return rows.mapInArrow(run, rows.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over undirected edges (src, tgt), which may repeat.

    Edges shrink to forests where they are read. Then each node steps to its smallest neighbour, and on to where such steps end; the edges between different ends
    are the next, smaller graph, until there are none. The smallest node of a component never steps, so it is its last end. Rounds are
    cut by checkpoints in the session's shared folder, and only counts of changes reach the driver."""
    from .lineage import checkpointed

    links, levels = checkpointed(forest(edges)), []
    while True:
        ends = links.select("src", "tgt").union(links.select("tgt", "src"))
        step = checkpointed(ends.groupBy(F.col("src").alias("id")).agg(F.min("tgt").alias("_m")).select("id", F.least("id", "_m").alias("to")))
        while True:
            on = step.select(F.col("id").alias("_r"), F.col("to").alias("_up"))
            new = checkpointed(step.join(on, F.col("to") == F.col("_r")).select("id", F.col("to").alias("was"), F.col("_up").alias("to")))
            step = new.select("id", "to")
            if new.filter("to <> was").limit(1).count() == 0:
                break
        levels.append(step)
        a, b = step.toDF("src", "_a"), step.toDF("tgt", "_b")
        met = links.join(a, "src").join(b, "tgt").filter("_a <> _b").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("tgt"))
        links = checkpointed(forest(met))
        if links.limit(1).count() == 0:
            break
    found = levels.pop()
    while levels:
        found = levels.pop().join(found.toDF("_r", "_up"), F.col("to") == F.col("_r"), "left").select("id", F.coalesce("_up", "to").alias("to"))
    return found.select("id", F.col("to").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes (ties: smallest label)."""
    comps = connected_components(edges)
    best = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return comps.join(best, "component", "left_semi")


def stable_component(edges: DataFrame) -> DataFrame:
    """(src, tgt), distinct: the edges of the largest component with their nodes relabelled (upper case, trimmed, character references decoded), each pair in its stored order."""
    from ..functions.text import unescape_html

    nodes = largest_component(edges)
    labels = nodes.select("id", unescape_html(F.trim(F.upper("id"))).alias("label"))
    a, b = labels.toDF("src", "_a"), labels.toDF("tgt", "_b")
    return edges.join(a, "src").join(b, "tgt").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("tgt")).distinct()
