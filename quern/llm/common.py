"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Sub-batches handed to numpy kernels hold about this many bytes of text (one longer text makes its own).
SLICE_BYTES = 4 << 20

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(raw: bytes) -> bytes:
    return raw.translate(_ASCII_LOWER)


def text_key(col: str | Column = "text") -> Column:
    """64-bit hash that tells rows with one doc_id but different texts apart (null counts as empty)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.xxhash64(F.coalesce(c, F.lit("")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder of the session, so that lost executors cost a re-read.

    Where the setting is absent a folder of this machine serves local sessions; on a cluster it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint(eager=True)


def by_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns named by place (_c0, _c1 ...), apart from any name an operator adds, and its own names."""
    names = df.columns
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), names


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 0 modulo 5; null ids count as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def widened(schema: StructType, ddl: str) -> StructType:
    """schema with the fields of a DDL string after its own."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``limit`` bytes each."""
    n = len(col)
    if not n:
        return
    ends = utf8(col)[1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column without copying; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def texts(col: pa.Array) -> list[str]:
    """Python strings of a string column, null as empty."""
    return [x or "" for x in col.to_pylist()]


def raw_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    raw, off = utf8(col)
    whole = raw.tobytes() if len(raw) else b""
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow list column from flat values and a length for each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def block_sums(parts: DataFrame, blocks: int, fan: int = 16) -> dict[int, np.ndarray]:
    """Sum float32 vectors by block over all rows (block int, part int, vec binary) and return the sums.

    The sums are streamed: tasks first add up ``fan`` salted shares of each block, then the shares, so no task
    holds more than one vector a block. Only ``blocks`` vectors, a number fixed by the model, reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, share, vec in zip(b["block"].to_pylist(), b["share"].to_pylist(), b["vec"].to_pylist()):
                v = np.frombuffer(vec, np.float32)
                if (block, share) in sums:
                    sums[block, share] += v
                else:
                    sums[block, share] = v.astype(np.float64)
        for (block, share), v in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "share": pa.array([share], pa.int32()), "vec": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    shape = "block int, share int, vec binary"
    shares = parts.select("block", F.pmod("part", F.lit(fan)).cast("int").alias("share"), "vec")
    shares = shares.repartition("block", "share").mapInArrow(add, shape)
    whole = shares.withColumn("share", F.lit(0)).repartition("block").mapInArrow(add, shape)
    out = {r.block: np.frombuffer(r.vec, np.float32).copy() for r in whole.collect()}
    if len(out) > blocks:
        raise ValueError(f"{len(out)} blocks, expected {blocks} at most")
    return out
