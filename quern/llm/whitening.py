"""Embedding whitening from a two-pass covariance.

Entries become whole numbers, x = floor(64 c) + 1000000. The first pass sums each dimension of the distinct vectors exactly, the second sums the
outer products of the centred vectors, (n x - S) / n, by one matrix product a batch; ``treeAggregate`` merges one matrix a task. The symmetric
eigenproblem is LAPACK's. A third pass whitens the distinct vectors and takes the covariance of the result, whose means are zero
because the centred vectors add up to exactly zero. The model (at most ``COMPONENTS`` vectors, means and
sums) is broadcast to the projection of all rows.

Scale: vectors are shuffled once, packed in a byte or two an entry, to make them distinct (aggregated in the tasks first, so that one vector in a
third of all rows costs nothing); every task holds a batch and one matrix of dims^2 doubles.

Edge cases: rows whose vector is null, holds a null or non-finite entry, or has another length than most vectors take no part; null ids are rows
like any other; repeated rows count once in the fit and each get their rows; components without variance (fewer distinct vectors than
dimensions, constant entries) can't be whitened and give no rows, so a table of one distinct vector gives none; an empty table gives an
empty result; other columns are ignored. Eigenvectors point where their largest entry is positive. Sums of products of
floating-point numbers arrive in any order, so the last digits of whitened may differ between runs; n and deviation are exact
(an error where deviation doesn't fit 64 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import dimension, scaled, unpack

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    n: int  # distinct vectors
    sums: np.ndarray  # of floor(64 c), by dimension, so that n x - S is free of the offset
    axes: np.ndarray  # dims x components, columns divided by the root of their eigenvalue
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray
    identity_error: float = float("nan")


def _summed(vectors: DataFrame, dims: int, one: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Sum of one(batch of vectors) over all vectors: one array a task, merged as a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            total += one(unpack(b.column(0), dims))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = vectors.select("x").mapInArrow(add, "part binary").rdd
    return parts.treeAggregate(np.zeros(shape, kind), lambda s, r: s + np.frombuffer(r[0], kind).reshape(shape), lambda a, b: a + b)


def _shifted(f: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if len(f) and n * float(np.abs(f).max()) + float(np.abs(sums).max()) >= 2.0**62:
        raise OverflowError("n times an entry doesn't fit 62 bits")
    return n * f - sums


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors (column x, packed); None without vectors."""
    distinct = checkpointed(vectors.select("x").distinct())

    def first(f: np.ndarray) -> np.ndarray:
        if np.abs(f).sum(dtype=np.float64) >= 2.0**62:
            raise OverflowError("the sums of a batch don't fit 62 bits")
        return np.append(f.sum(axis=0), len(f))

    *sums, n = _summed(distinct, dims, first, (dims + 1,), np.int64).tolist()
    if not n:
        return None
    sums = np.array(sums, np.int64)

    def outer(f: np.ndarray) -> np.ndarray:
        c = _shifted(f, n, sums) / n
        return c.T @ c

    v = _summed(distinct, dims, outer, (dims, dims), np.float64) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * dims * np.finfo(float).eps).sum())) if e[0] > 0 else 0
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    model = Model(n, sums, u[:, :k] / np.sqrt(e[:k]), e[:k], e[:k] / np.trace(v) if k else e[:0])
    if k:

        def white(f: np.ndarray) -> np.ndarray:
            w = (_shifted(f, n, sums) / n) @ model.axes
            return w.T @ w

        model.identity_error = float(np.abs(_summed(distinct, dims, white, (k, k), np.float64) / n - np.eye(k)).max())
    return model


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = rows.sparkSession
    dims = dimension(rows, vector)
    src = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("_vector"))
    vectors = scaled(src, SCALE, dims, ["vec_id"], "_vector") if dims else None
    model = fit(vectors, dims, components) if dims else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], _FIELDS)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for b in batches:
            d = _shifted(unpack(b.column(1), dims), m.n, m.sums)
            if len(d) and (d.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
                raise OverflowError("a deviation doesn't fit 64 bits")
            far = (d * d).sum(axis=1)
            rows = len(d)
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)), pa.array(np.repeat(far, k)),
                pa.array(((d / m.n) @ m.axes).ravel()), pa.array(np.tile(m.explained, rows)), pa.array(np.full(rows * k, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, _FIELDS)


#: DuckDB SQL for vec_id, n and deviation (eigenvectors have no SQL form), for vectors of one length.
DEVIATION_SQL = """
with kept as (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint + 1000000) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), fitted as (select distinct x from kept),
entries as (select unnest(x) as v, generate_subscripts(x, 1) as d from fitted),
sums as (select list(s order by d) as s, max(n) as n from (select d, sum(v)::bigint as s, count(*) as n from entries group by d))
select vec_id, n, list_sum(list_transform(list_zip(x, s), lambda z: (n * z[1] - z[2]) * (n * z[1] - z[2])))::bigint as deviation from kept, sums"""
