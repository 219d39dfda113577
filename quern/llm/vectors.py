"""Embedding vectors as exact integers, packed in binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

_WIDTHS = (1, 2, 4, 8)


def dimension(rows: DataFrame, vector: str = "embedding") -> int:
    """The length of the most vectors (ties: the longest); 0 if there are none. One row reaches the driver."""
    n = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.max(F.struct("n", "d")).alias("b")).first().b
    return best.d if best else 0


def pack(whole: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, each in the narrowest width that holds all its values, so that equal rows have equal bytes."""
    least, most = whole.min(axis=1, initial=0), whole.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(whole)
    done = np.zeros(len(whole), bool)
    for w in _WIDTHS:
        kind = np.dtype(f"<i{w}")
        fits = ~done & (least >= np.iinfo(kind).min) & (most <= np.iinfo(kind).max)
        part = whole[fits].astype(kind)
        for i, row in zip(np.flatnonzero(fits).tolist(), part):
            out[i] = row.tobytes()
        done |= fits
    return out


def unpack(col: pa.Array, dims: int) -> np.ndarray:
    """int64 rows of a column made by pack; dims > 0."""
    raw, ends = utf8(col)
    out = np.empty((len(col), dims), np.int64)
    widths = np.diff(ends) // dims
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        if len(at) == len(col):
            part = raw[ends[0] : ends[-1]]
        else:
            part = np.concatenate([raw[ends[i] : ends[i + 1]] for i in at.tolist()])
        out[at] = np.frombuffer(part.tobytes(), f"<i{w}").reshape(len(at), dims)
    return out


def scaled(rows: DataFrame, scale: int, dims: int, keep: list[str], vector: str = "embedding") -> DataFrame:
    """(keep..., x): the rows whose vector has ``dims`` finite entries, x the packed floor(scale * entry), entries as doubles.

    An entry whose result doesn't fit 62 bits stops the query with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            fits = pc.equal(pc.fill_null(pc.list_value_length(lists), -1), dims)
            b = b.filter(fits)
            flat = pc.fill_null(b.column(len(keep)).flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            good = np.isfinite(flat).all(axis=1)
            whole = np.floor(flat[good] * scale)
            if len(whole) and np.abs(whole).max() >= 2.0**62:
                raise ValueError(f"{scale} times an entry doesn't fit 62 bits")
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(mask) for i in range(len(keep))), pa.array(pack(whole.astype(np.int64)), pa.binary())], [*keep, "x"])

    src = rows.select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, x binary")
