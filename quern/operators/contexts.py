"""Graph contexts for a table of queries: each query's hits, and the relations, entities and sources around them, within budgets of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from .lineage import checkpointed

#: Budgets of a section's tokens: relations, entities, sources.
LOCAL, GLOBAL = (4000, 1000, 2000), (2000, 1000, 2000)


def words(line: str) -> Column:
    """Runs of ASCII letters and digits, the measure where no vocabulary is given."""
    return F.regexp_count(F.col(line), F.lit("[A-Za-z0-9]+")).cast("long")


def fitting(rows: DataFrame, line: str, order: list[Column], budget: int, tokens: Callable[[str], Column]) -> DataFrame:
    """Each query's rows in order whose lines fit the budget. A line counts a token at least, so only ``budget`` rows a query are counted, and
    the others leave in the tasks before the rows of a query meet."""
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= budget)
    counted = best.withColumn("tokens", F.greatest(tokens(line).cast("long"), F.lit(1).cast("long")))
    # in the same order, which is kept, so nothing is sorted again
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("running", running).filter(F.col("running") <= budget).drop("_r")


#: The most ids that a search among all rows sends to every task (more are met by their keys), and the rows of queries that a task gets on average.
SENT, TASK_ROWS = 1 << 21, 1 << 18


def by_query(rows: DataFrame, n: int) -> DataFrame:
    """rows, about n, dealt by their query over so many tasks that each gets about TASK_ROWS."""
    return rows.repartition(max(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), "query_id")


def among(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose value of a column is one of the ids (id), a checkpoint. Up to ``SENT`` ids go to every task, so the rows stay where they are."""
    named = ids.select(F.col("id").alias(col))
    return rows.join(F.broadcast(named) if ids.count() <= SENT else named.hint("shuffle_hash"), col, "left_semi")


def fitting_places(rows: DataFrame, budget: int, n: int, once: bool = True) -> DataFrame:
    """(query_id, pos, tokens, running) of rows (query_id, places, counts), about n, the parallel arrays of the places that a hit of the query offers and of their tokens:
    each query's places, each once where this is asked, in order while the running sum of tokens stays within the budget."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def cut(parts):
            queries = np.concatenate([np.repeat(q, sizes) for q, sizes, _, _ in parts])
            pos, tokens = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            order = np.lexsort((pos, queries))
            queries, pos, tokens = queries[order], pos[order], tokens[order]
            if once:
                new = np.concatenate([[True], (queries[1:] != queries[:-1]) | (pos[1:] != pos[:-1])])[: len(pos)]
                queries, pos, tokens = queries[new], pos[new], tokens[new]
            total = np.cumsum(tokens)
            first = np.flatnonzero(np.concatenate([[True], queries[1:] != queries[:-1]])[: len(pos)])
            running = total - np.repeat(total[first] - tokens[first], np.diff([*first, len(pos)]))
            kept = running <= budget
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (queries, pos, tokens, running)], ["query_id", "pos", "tokens", "running"])

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            q, places, counts = b.column("query_id").to_numpy(), b.column("places"), b.column("counts")
            piece = lambda lo, hi: (q[lo:hi], np.diff(places.slice(lo, hi - lo).offsets.to_numpy()), *(c.slice(lo, hi - lo).flatten().to_numpy() for c in (places, counts)))
            last = int(np.searchsorted(q, q[-1]))  # the last query may go on in the next batch
            if held and (last or held[0][0][0] != q[0]):
                same = int(np.searchsorted(q, held[0][0][0], side="right"))
                yield cut([*held, piece(0, max(last, same))])
                held = []
                if last < same:
                    continue
            elif last:
                yield cut([piece(0, last)])
            held.append(piece(last, len(q)))
        if held:
            yield cut(held)

    # a row holds dozens of places
    dealt = by_query(rows.select("query_id", "places", "counts"), 4 * n).sortWithinPartitions("query_id")
    return dealt.mapInArrow(run, "query_id long, pos long, tokens long, running long")


class Graph:
    """A property graph for contexts. What the hits of all queries don't touch is left where it is read: mentions and edges are searched for them, degrees are
    counted of the ends of their edges. Lines, tokens and order belong to an edge, so they are found once an edge, not once a query.

    edges: (src, tgt, weight), or None where a pair's edge is the sum of its mentions; nodes: (id, name); mentions: (chunk, src, tgt, quantity), the chunks that
    name a pair; label: the text of a column of ids, where these are stored as numbers."""

    def __init__(self, edges: DataFrame | None, nodes: DataFrame, mentions: DataFrame, label: Callable[[str], Column] = F.col) -> None:
        self.edges = None if edges is None else edges.select("src", "tgt", "weight")
        self.nodes, self.mentions, self.label = nodes, mentions, label

    def degrees(self, ids: DataFrame) -> DataFrame:
        """(id, degree) of the ids: a loop counts twice."""
        pairs = self.mentions if self.edges is None else self.edges
        sides = [among(pairs.select(F.col(a).alias("id"), F.col(b).alias("_other"), F.lit(a).alias("_side")), ids, "id") for a, b in (("src", "tgt"), ("tgt", "src"))]
        ends = sides[0].unionByName(sides[1])
        if self.edges is None:  # most pairs have a mention or two: they meet before they are made one
            ends = ends.repartition("id", "_other", "_side").distinct()
        return checkpointed(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")))

    def touched(self, rows: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
        """The rows that begin, or in local mode begin or end, at one of the ids."""
        begin = among(rows, ids, "src").select(*rows.columns)
        if mode != "local":
            return begin
        end = among(rows, ids, "tgt").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
        return begin.unionByName(end)

    def around(self, hits: DataFrame, mode: str) -> Around:
        """What the contexts of these hits are made of."""
        ids = checkpointed(hits.select("id").distinct())
        named = None
        if self.edges is None:
            named = checkpointed(self.touched(self.mentions.select("chunk", "src", "tgt", "quantity"), ids, mode))
            edges = named.groupBy("src", "tgt").agg(F.sum("quantity").alias("weight"))
        else:
            edges = self.touched(self.edges, ids, mode)
        edges = checkpointed(edges)
        degree = self.degrees(checkpointed(edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()))
        return Around(ids, G.with_edge_rank(edges, degree).select("src", "tgt", "weight", "rank"), degree, self.mentions if named is None else named, self.label)

    def near(self, hits: DataFrame, mode: str) -> DataFrame:
        """(src, tgt, weight, rank) of the edges that begin, or in local mode begin or end, at a hit of any query."""
        return self.around(hits, mode).edges

    def sections(self, hits: DataFrame, mode: str, budgets: tuple[int, int, int], tokens: Callable[[str], Column] = words, around: Around | None = None) -> DataFrame:
        """(query_id, section, line, tokens, running) of the local or global context of every query with hits (query_id, id, similarity)."""
        around = around or self.around(hits, mode)
        kept, label = around.relations(hits, mode, budgets[0], tokens), self.label
        n = kept.count()
        relations = kept.join(around.placed.select("pos", "line"), "pos")
        if mode == "local":
            entities = hits.select("query_id", "id", (-F.col("similarity")).alias("at")).join(self.nodes, "id").join(around.degree, "id")
        else:
            known = self.nodes.join(around.degree, "id").withColumn("at", (-F.col("degree")).cast("double"))
            ends = around.placed.select("pos", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("id")).join(known, "id", "left_semi")
            entities = by_query(kept.join(ends, "pos").select("query_id", "id"), n).distinct().join(known, "id")
        entities = entities.withColumn("_id", label("id"))
        entities = fitting(entities.withColumn("line", F.concat_ws(",", "_id", "name", "degree")), "line", [F.col("at"), F.col("_id")], budgets[1], tokens)
        named = by_query(around.named.join(kept.select("query_id", "pos", F.col("running").alias("at")), "pos").drop("pos"), n)
        named = named.groupBy("query_id", "chunk").agg(F.min("at").alias("at"), F.sum("quantity").alias("quantity"))
        sources = fitting(named.withColumn("line", F.concat_ws(",", "chunk", "quantity")), "line", [F.col("at"), F.col("chunk")], budgets[2], tokens)
        parts = [df.select("query_id", F.lit(name).alias("section"), "line", "tokens", "running") for name, df in (("relations", relations), ("entities", entities), ("sources", sources))]
        return parts[0].union(parts[1]).union(parts[2])

    def both(self, hits: DataFrame, local: tuple[int, int, int] = LOCAL, over: tuple[int, int, int] = GLOBAL, tokens: Callable[[str], Column] = words) -> DataFrame:
        """(query_id, section, place, line, tokens): both contexts merged section by section, each line once, the local ones first, in their order."""
        local_most = max(local)  # a number, not a pair of mode and number, can be kept in a hash table
        around = self.around(hits, "local")  # holds the edges of the global mode as well
        a = self.sections(hits, "local", local, tokens, around).withColumn("at", F.col("running"))
        b = self.sections(hits, "global", over, tokens, around).withColumn("at", F.col("running") + local_most)
        one = by_query(a.union(b), 8 * hits.count()).groupBy("query_id", "section", "line").agg(F.min("at").alias("at"), F.min("tokens").alias("tokens"))
        return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "section").orderBy("at"))).select("query_id", "section", "place", "line", "tokens")


class Around:
    """The edges at the hits of all queries, once for all of these.

    ids: (id); edges: (src, tgt, weight, rank); degree: (id, degree) of all ends; placed: the edges with their line and their place in the order of
    relations, which is the same for every query; named: (pos, chunk, quantity) of the edges' mentions."""

    def __init__(self, ids: DataFrame, edges: DataFrame, degree: DataFrame, mentions: DataFrame, label: Callable[[str], Column]) -> None:
        self.ids, self.edges, self.degree = ids, edges, degree
        shown = edges.withColumns({"_src": label("src"), "_tgt": label("tgt")})
        ordered = shown.orderBy(F.desc("rank"), F.desc("weight"), "_src", "_tgt").withColumn("pos", F.monotonically_increasing_id())
        self.placed = checkpointed(ordered.select("pos", "src", "tgt", F.concat_ws(",", "_src", "_tgt", "weight", "rank").alias("line")))
        self.named = mentions.join(self.placed.select("src", "tgt", "pos"), ["src", "tgt"]).select("pos", "chunk", "quantity")

    def relations(self, hits: DataFrame, mode: str, budget: int, tokens: Callable[[str], Column]) -> DataFrame:
        """(query_id, pos, tokens, running) of each query's relations within the budget. A line counts a token at least, so a hit offers its first ``budget``."""
        ends = self.placed.select(F.col("src").alias("id"), "pos", "line")
        if mode == "local":
            ends = ends.unionByName(among(self.placed.select(F.col("tgt").alias("id"), "pos", "line"), self.ids, "id"))
        best = ends.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter(F.col("_r") <= budget)
        counted = best.select("id", F.struct("pos", F.greatest(tokens("line").cast("long"), F.lit(1).cast("long")).alias("tokens")).alias("_e"))
        lists = counted.groupBy("id").agg(F.collect_list("_e").alias("_e")).select("id", F.col("_e.pos").alias("places"), F.col("_e.tokens").alias("counts"))
        return checkpointed(fitting_places(hits.select("query_id", "id").join(lists, "id"), budget, hits.count(), mode == "local"))
