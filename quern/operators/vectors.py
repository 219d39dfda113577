"""Vector search on array<float> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int = 60, floor: float | None = 0.2, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine at or above the floor (ties by id), best first: (id, similarity). The query is a literal and the
    ranking a per-partition top-k, so nothing is shuffled but k rows a partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(id_col, F.round(cosine(F.col(vector), q), 6).alias("similarity"))
    if floor is not None:
        rows = rows.filter(F.col("similarity") >= floor)
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


#: Most rows of a part and queries of a block, queries multiplied at once, and rows multiplied at once: few at first, until a query has its first best.
ROWS, ASKS, BATCH, CHUNKS = 1 << 22, 1 << 15, 512, (256, 1024, 4096)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 60, floor: float | None = 0.2, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity): for each row (query_id, query_vector) of a table of queries the k nearest vectors by cosine (six digits) at or above the floor, ties by id.

    Vectors lie in parts and queries in blocks of ``ASKS`` at most. A task holds one block with its queries' best so far, and the rows of one part stream by, so
    what it holds is the same however many rows there are. Only a few queries need several parts to keep all cores busy. Products of single floats, with a bound
    on their error, find the rows that may reach the floor and a query's k-th best so far; only those are multiplied in full. Where there are more parts, each
    returns k rows a query at most, and only those are ranked. Null, empty, zero and ragged vectors (another length than the query) match nothing."""
    spark = vectors.sparkSession
    # single floats travel as they are and become double in the tasks
    single = all(df.schema[c].dataType.simpleString() == "array<float>" for df, c in ((vectors, vector), (queries, "query_vector")))
    kind = "array<float>" if single else "array<double>"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("v is not null and id is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("query_vector").cast(kind).alias("v")).filter("v is not null")
    n, m, busy = src.count(), asked.count(), 2 * spark.sparkContext.defaultParallelism
    blocks = max(-(-m // ASKS), min(busy, -(-m // 1024)), 1)
    parts = max(-(-n // ROWS), min(-(-busy // blocks), -(-n // 1024)), 1)
    own = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = src.select("id", "v", own(parts).alias("part"), every(blocks).alias("block"), F.lit(False).alias("ask"))
    asked = asked.select("id", "v", own(blocks).alias("block"), every(parts).alias("part"), F.lit(True).alias("ask")).select(*rows.columns)
    least = -2.0 if floor is None else floor

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def read(ids, col):
            """{length: (ids, vectors, their lengths in space, single unit vectors)}"""
            at, flat, out = col.offsets.to_numpy(), col.values, {}
            bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            values, sizes = flat.fill_null(0).to_numpy(zero_copy_only=False), np.diff(at)
            sizes[bad[at[1:]] > bad[at[:-1]]] = 0
            for d in set(sizes.tolist()) - {0}:
                of = np.flatnonzero(sizes == d)
                v = values[at[of][:, None] + np.arange(d)].astype(np.float64)
                size = np.sqrt((v * v).sum(axis=1))
                good = np.isfinite(size) & (size > 0)
                out[d] = (ids[of][good], v[good], size[good], (v[good] / size[good, None]).astype(np.float32))
            return out

        # one piece of memory for all products: to get and return it each time would cost more than they do
        products, reaches = np.empty(BATCH * CHUNKS[-1], np.float32), np.empty(BATCH * CHUNKS[-1], bool)

        class Best:
            """The best rows so far of the queries of one length."""

            def __init__(self, asks):
                self.ids, self.v, self.size, self.unit = (np.concatenate(x) for x in zip(*asks))
                self.found, self.near = np.zeros((len(self.ids), k), np.int64), np.full((len(self.ids), k), -np.inf)
                self.slack, self.seen = 1e-6 + 2.0**-23 * (self.v.shape[1] + 4), 0

            def meet(self, ids, v, size, unit):
                lo = 0
                while lo < len(ids):
                    hi = lo + next((c for c in CHUNKS if self.seen < 4 * c), CHUNKS[-1])
                    for a in range(0, len(self.ids), BATCH):
                        self.take(slice(a, a + BATCH), ids[lo:hi], v[lo:hi], size[lo:hi], unit[lo:hi])
                    self.seen, lo = self.seen + hi - lo, hi

            def take(self, some, ids, v, size, unit):
                near, found = self.near[some], self.found[some]
                bar = (np.maximum(near[:, -1], least) - self.slack).astype(np.float32)
                shape = len(near), len(ids)
                product, reach = (x[: shape[0] * shape[1]].reshape(shape) for x in (products, reaches))
                np.matmul(self.unit[some], unit.T, out=product)
                at = np.flatnonzero(np.greater_equal(product, np.nextafter(bar, np.float32(-np.inf))[:, None], out=reach))
                if not len(at):
                    return
                q, r = np.divmod(at, len(ids))
                s = np.round(np.einsum("ij,ij->i", self.v[some][q], v[r]) / (self.size[some][q] * size[r]), 6)
                ok = s >= np.maximum(near[q, -1], least)
                if not ok.any():
                    return
                q, s, r = q[ok], s[ok], ids[r[ok]]
                old = np.unique(q)
                q, s, r = np.concatenate([q, np.repeat(old, k)]), np.concatenate([s, near[old].ravel()]), np.concatenate([r, found[old].ravel()])
                order = np.lexsort((r, -s, q))
                q, s, r = q[order], s[order], r[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                place = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
                q, s, r, place = (x[place < k] for x in (q, s, r, place))
                near[q, place], found[q, place] = s, r  # views: a query of the piece has k places, old ones among them

            def rows(self):
                q, place = np.nonzero(self.near > -np.inf)
                return self.ids[q], self.found[q, place], self.near[q, place]

        def result(best):
            if not best:
                return
            q, r, near = (np.concatenate(x) for x in zip(*(b.rows() for b in best.values())))
            asked = np.concatenate([b.ids for b in best.values()])
            if len(np.unique(asked)) < len(asked):  # several vectors of one query share its places
                order = np.lexsort((r, -near, q))
                q, r, near = q[order], r[order], near[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
                kept = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)])) < k
                q, r, near = q[kept], r[kept], near[kept]
            for lo in range(0, len(q), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in (q, r, near)], ["query_id", "id", "similarity"])

        asks, best, task = {}, {}, None
        for b in batches:
            where, ask = b.column("part").to_numpy() * blocks + b.column("block").to_numpy(), b.column("ask").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((where[1:] != where[:-1]) | (ask[1:] != ask[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(where)]):
                if lo == hi:
                    continue
                if where[lo] != task:
                    yield from result(best)
                    asks, best, task = {}, {}, where[lo]
                for d, x in read(b.column("id").slice(lo, hi - lo).to_numpy(), b.column("v").slice(lo, hi - lo)).items():
                    if ask[lo]:
                        asks.setdefault(d, []).append(x)
                    elif d in asks or d in best:
                        if d in asks:
                            best[d] = Best(asks.pop(d))
                        best[d].meet(*x)
        yield from result(best)

    # four times the tasks: fewer blocks then share a task by chance
    met = rows.union(asked).repartition(4 * parts * blocks, "part", "block").sortWithinPartitions("part", "block", F.desc("ask")).mapInArrow(run, "query_id long, id long, similarity double")
    if parts == 1:
        return met
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return met.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
