"""Hard negatives for anchor vectors by a pivot table.

Vectors are whole numbers and scores exact inner products. A further entry sqrt(M^2 - |y|^2) (M: the longest vector), which anchors have as 0, turns the inner
product into a Euclidean distance: d(a, y)^2 = |a|^2 + M^2 - 2 a.y. The pivot table stores every row's distances to ``PIVOTS`` rows spread by farthest-first choice;
by the triangle inequality |d(a, p) - d(y, p)| <= d(a, y) <= d(a, p) + d(y, p), so the stored distances bracket a score without the
vector. Brackets drop whole blocks of rows first (by the range of the distances in a block), then rows; what survives is checked by the exact
product. A first round finds each anchor's positives, a second one the negatives within their range of scores.

Scale: anchors are a share of all rows and meet all rows in blocks: rows lie in parts of at most ``ROWS``, each read once a round, and anchors stream through every
part, so a task holds one part and a batch of anchors, and results leave as the best few of each part. Neither labels nor ids deal the
rows out, so no label is hot. What brackets can't drop (vectors without structure) costs the product of anchors and rows.

Edge cases: rows with a null label, a null vector, a null or non-finite entry, or another length than most vectors take no part; repeated rows
(equal id, label and vector) are one row; rows of one id but other labels or vectors are rows of their own, each an anchor where the id is one; null ids can't
be anchors and come last among ties; an anchor without a positive or without a negative gives no row; an empty table gives an empty
result; other columns are ignored. Products must fit 62 bits, else the query stops with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import dimension, scaled, unpack

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LEAST percent of the positive's and the positive's.
LEAST = 80
#: Pivots, and the rows (of the smallest hashes) from which they are chosen. Any pivots give right results.
PIVOTS, PIVOT_SAMPLE = 8, 256
#: Most rows of a part, rows of a block, anchors taken at once.
ROWS, BLOCK, BATCH = 1 << 16, 64, 64
_FIELDS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def exact_products(a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Inner products of integer rows, exactly; longest: the largest squared length, which bounds every sum on the way."""
    if longest < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if longest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(x: np.ndarray) -> np.ndarray:
    if len(x) and (x.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**62:
        raise OverflowError("an inner product may not fit 62 bits")
    return (x * x).sum(axis=1)


def spread(x: np.ndarray, longest: int, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice of rows in the augmented space."""
    if not len(x):
        return x
    tall = np.sqrt(np.maximum(longest - squares(x), 0).astype(np.float64))
    whole = np.column_stack([x.astype(np.float64), tall])
    far, out = np.full(len(x), np.inf), [0]
    while len(out) < min(pivots, len(x)):
        far = np.minimum(far, ((whole - whole[out[-1]]) ** 2).sum(axis=1))
        out.append(int(far.argmax()))
    return x[out]


def row_distances(x: np.ndarray, pivots: np.ndarray, longest: int) -> np.ndarray:
    """Distances of augmented rows to augmented pivots."""
    tall = lambda y: np.sqrt(np.maximum(longest - squares(y), 0).astype(np.float64))
    d = 2.0 * longest - 2.0 * exact_products(x, pivots, longest) - 2.0 * tall(x)[:, None] * tall(pivots)[None, :]
    return np.sqrt(np.maximum(d, 0)).astype(np.float32)


def anchor_distances(x: np.ndarray, pivots: np.ndarray, longest: int) -> np.ndarray:
    d = squares(x)[:, None] + float(longest) - 2.0 * exact_products(x, pivots, longest)
    return np.sqrt(np.maximum(d, 0)).astype(np.float32)


def bracket(own: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each anchor (distances ``own``, squared lengths ``norms``) with rows whose pivot distances lie in [low, high].

    Single-precision distances err by less than the slack, which widens the bracket."""
    slack = np.float32(1e-5 * longest**0.5 + 1e-3)
    near = np.zeros((len(own), len(low)), np.float32)
    far = np.full_like(near, np.inf)
    for j in range(own.shape[1]):
        a = own[:, j, None]
        np.maximum(near, np.maximum(low[None, :, j] - a, a - high[None, :, j]), out=near)
        np.minimum(far, a + high[None, :, j], out=far)
    top = norms[:, None] + float(longest)
    near = np.maximum(near - slack, 0).astype(np.float64)
    return (top - (far + slack).astype(np.float64) ** 2) / 2 - 1, (top - near**2) / 2 + 1


class Part:
    """The rows of a part, by label and nearest pivot, with the ranges of pivot distances of their blocks."""

    def __init__(self, rows: dict[str, np.ndarray], longest: int) -> None:
        closest = rows["pivots"].argmin(axis=1)
        order = np.lexsort((rows["pivots"][np.arange(len(closest)), closest], closest, rows["label"]))
        self.rows = {k: v[order] for k, v in rows.items()}
        self.longest = longest
        r = self.rows
        # order of ties: smaller ids, no id last
        self.tie = np.empty(len(order), np.int64)
        self.tie[np.lexsort((r["key"], r["id"], ~r["has_id"]))] = np.arange(len(order))
        starts = np.flatnonzero(np.append(True, r["label"][1:] != r["label"][:-1]))
        cuts = np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip(starts, np.append(starts[1:], len(order)))])
        self.cuts = np.append(cuts, len(order))
        self.low, self.high = (f.reduceat(r["pivots"], cuts, axis=0) for f in (np.minimum, np.maximum))
        self.block_label = r["label"][cuts]
        self.block_of = np.repeat(np.arange(len(cuts)), np.diff(self.cuts))

    def survivors(self, anchors: dict[str, np.ndarray], same: bool, least: np.ndarray, most: np.ndarray, best: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, exact scores) of the rows that brackets can't drop; same: rows of the anchor's label, else all others. Scores outside of [least, most]
        may be missing, and with ``best`` those below the best scores that the brackets promise."""
        lo, hi = bracket(anchors["pivots"], anchors["norm"], self.low, self.high, self.longest)
        open_blocks = (hi >= least[:, None]) & (lo <= most[:, None]) & ((anchors["label"][:, None] == self.block_label[None, :]) == same)
        used = open_blocks.any(axis=0)
        at = np.flatnonzero(used[self.block_of])
        if not len(at):
            return
        lo, hi = bracket(anchors["pivots"], anchors["norm"], self.rows["pivots"][at], self.rows["pivots"][at], self.longest)
        kept = open_blocks[:, self.block_of[at]] & (hi >= least[:, None]) & (lo <= most[:, None])
        if best and len(at) > best:
            promised = np.partition(np.where(kept, lo, -np.inf), -best, axis=1)[:, -best]
            kept &= hi >= promised[:, None]
        dense = None
        if 4 * kept.sum() > kept.size:
            dense = exact_products(anchors["x"], self.rows["x"][at], self.longest)
        for i in np.flatnonzero(kept.any(axis=1)).tolist():
            own = np.flatnonzero(kept[i])
            scores = dense[i, own] if dense is not None else exact_products(anchors["x"][i : i + 1], self.rows["x"][at[own]], self.longest)[0]
            yield i, at[own], scores


def _columns(b: pa.RecordBatch, dims: int) -> dict[str, np.ndarray]:
    ids = b.column("vec_id")
    x = unpack(b.column("x"), dims)
    return {
        "id": ids.fill_null(0).to_numpy(), "has_id": ids.is_valid().to_numpy(zero_copy_only=False), "label": b.column("label").to_numpy(), "key": b.column("key").to_numpy(), "x": x,
        "norm": squares(x), "pivots": np.frombuffer(b"".join(b.column("pivots").to_pylist()), np.float32).reshape(len(x), -1),
    }


def _through_parts(batches: Iterator[pa.RecordBatch], dims: int, longest: int) -> Iterator[tuple[Part, pa.RecordBatch]]:
    """(part, batch of anchors) from rows sorted by (part, is_anchor)."""
    held: list[dict[str, np.ndarray]] = []
    part, at = None, None
    for whole in batches:
        if not whole.num_rows:
            continue
        parts, kinds = whole.column("part").to_numpy(), whole.column("is_anchor").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
            if parts[lo] != at:
                held, part, at = [], None, parts[lo]
            b = whole.slice(lo, hi - lo)
            if not kinds[lo]:
                held.append(_columns(b, dims))
                continue
            if part is None and held:
                part = Part({k: np.concatenate([h[k] for h in held]) for k in held[0]}, longest)
                held = []
            if part is not None:
                for k in range(0, b.num_rows, BATCH):
                    yield part, b.slice(k, BATCH)


def _first(scores: np.ndarray, ties: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by ``ties``."""
    if len(scores) > 4 * n:
        few = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return few[np.lexsort((ties[few], -scores[few]))[:n]]
    return np.lexsort((ties, -scores))[:n]


def _table(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)


def _ids(part: Part, at: np.ndarray) -> list[int | None]:
    return [i if ok else None for i, ok in zip(part.rows["id"][at].tolist(), part.rows["has_id"][at].tolist())]


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, vector); is_anchor: a condition on vec_id.

    For each anchor and each of its ``positives`` first rows of its label, the ``negatives`` first rows of other labels whose score lies between ``least`` percent
    of the positive's score and that score. First: highest score, ties by smaller vec_id."""
    spark = rows.sparkSession
    dims = dimension(rows, vector)
    if not dims:
        return spark.createDataFrame([], _FIELDS)
    src = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("_vector")).filter("label is not null")
    one = checkpointed(scaled(src, scale, dims, ["vec_id", "label"], "_vector").distinct().withColumn("key", F.xxhash64("vec_id", "label", "x")))
    longest, count = _longest(one, dims)
    sample = one.orderBy("key").limit(PIVOT_SAMPLE).select("x").collect()
    pivots = spread(unpack(pa.array([r.x for r in sample], pa.binary()), dims) if sample else np.zeros((0, dims), np.int64), longest)
    if not len(pivots):
        return spark.createDataFrame([], _FIELDS)

    def stored(distances: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = distances(unpack(b.column("x"), dims), pivots, longest)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in d], pa.binary())], [*b.schema.names, "pivots"])

        return run

    shape = "vec_id long, label long, x binary, key long, pivots binary"
    table = checkpointed(one.mapInArrow(stored(row_distances), shape))
    anchors = one.filter(is_anchor).mapInArrow(stored(anchor_distances), shape)
    # parts: enough for all cores, and small enough for a task
    parts = max(-(-count // ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-count // 1024)))
    own = table.select("*", F.pmod("key", F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("is_anchor"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = lambda a, r: r.unionByName(a, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "is_anchor")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in _through_parts(batches, dims, longest):
            a, found = _columns(b, dims), []
            anything = np.full(b.num_rows, np.inf)
            for i, at, scores in part.survivors(a, True, -anything, anything, positives + 1):
                other = part.rows["key"][at] != a["key"][i]
                at, scores = at[other], scores[other]
                best = _first(scores, part.tie[at], positives)
                for k, pid, s in zip(at[best].tolist(), _ids(part, at[best]), scores[best].tolist()):
                    found.append((int(a["key"][i]), pid, int(part.rows["key"][k]), s))
            yield _table(found, ["anchor", "positive_id", "positive", "score"], [pa.int64()] * 4)

    near = dealt(anchors.select("*", everywhere).withColumn("is_anchor", F.lit(True)), own).mapInArrow(nearest, "anchor long, positive_id long, positive long, score long")
    order = [F.desc("score"), F.col("positive_id").asc_nulls_last(), F.col("positive")]
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("at") <= positives)
    pos = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", "score", "positive_id"))).alias("near"))
    ready = anchors.join(pos, F.col("key") == F.col("anchor")).drop("anchor")
    ready = checkpointed(ready.withColumn("scores", F.transform("near", lambda p: p["score"])))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in _through_parts(batches, dims, longest):
            a, found = _columns(b, dims), []
            wanted = b.column("scores").to_pylist()
            # a negative positive score has no score between its share and itself
            some = [[s for s in w if s >= 0] for w in wanted]
            floor = lambda s: -(-least * s // 100)  # noqa: E731  the least score of a positive's negatives
            low = np.array([floor(min(s)) if s else np.inf for s in some], np.float64)
            high = np.array([max(s) if s else -np.inf for s in some], np.float64)
            for i, at, scores in part.survivors(a, False, low, high):
                inside = (scores >= floor(min(some[i]))) & (scores <= max(some[i]))
                at, scores = at[inside], scores[inside]
                by = np.lexsort((part.tie[at], -scores))
                at, scores = at[by], scores[by]
                for k, s in enumerate(wanted[i]):
                    if s < 0:
                        continue
                    lo = int(np.searchsorted(-scores, -s, side="left"))
                    hi = min(lo + negatives, int(np.searchsorted(-scores, -floor(s), side="right")))
                    for j, nid in zip(range(lo, hi), _ids(part, at[lo:hi])):
                        found.append((int(a["key"][i]), k + 1, nid, int(part.rows["key"][at[j]]), int(scores[j])))
            yield _table(found, ["anchor", "at", "negative_id", "negative", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])

    far = dealt(ready.select(*anchors.columns, "scores", everywhere).withColumn("is_anchor", F.lit(True)), own)
    far = far.mapInArrow(between, "anchor long, at int, negative_id long, negative long, score long")
    order = [F.desc("score"), F.col("negative_id").asc_nulls_last(), F.col("negative")]
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "at").orderBy(*order))).filter(F.col("rank") <= negatives)
    out = far.join(ready.select("key", F.col("vec_id").alias("anchor_id"), "near"), F.col("anchor") == F.col("key"))
    chosen = F.element_at("near", F.col("at"))
    return out.select("anchor_id", chosen["positive_id"].alias("positive_id"), "rank", "negative_id", chosen["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def _longest(rows: DataFrame, dims: int) -> tuple[int, int]:
    """The largest squared length and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = n = 0
        for b in batches:
            if b.num_rows:
                most, n = max(most, int(squares(unpack(b.column(0), dims)).max())), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64()), pa.array([n], pa.int64())], ["most", "n"])

    r = rows.select("x").mapInArrow(run, "most long, n long").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
    return r.most or 0, r.n or 0


def relabelled() -> Column:
    """The label, moved on by one modulo 10 where vec_id is divisible by 7."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


#: DuckDB SQL for hard_negatives over relabelled rows, anchors: ids divisible by 100.
NEGATIVES_SQL = """
with kept as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label,
    list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::bigint as score
  from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, own, id as positive_id, score as positive_score from scored where label = own
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank,
  s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> p.own and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) <= 5"""
