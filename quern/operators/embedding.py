"""Embedders and vector stores: texts to vectors in bounded batches, and keyed upserts that a replay doesn't change."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots


@dataclass(frozen=True)
class Embedder:
    """What a vector store needs to know of a model: func gets at most ``batch`` texts of at most ``max_tokens`` words each (longer ones are cut) and returns a
    row of ``dim`` numbers for each."""

    dim: int
    func: Callable[[list[str]], np.ndarray]
    max_tokens: int = 8192
    batch: int = 32

    def rows(self, texts: list[str]) -> np.ndarray:
        cut = [t if t.count(" ") < self.max_tokens else " ".join(t.split()[: self.max_tokens]) for t in texts]
        out = [np.asarray(self.func(cut[i : i + self.batch]), np.float64) for i in range(0, len(cut), self.batch)]
        for part in out:
            if part.ndim != 2 or part.shape[1] != self.dim:
                raise ValueError(f"an embedder of {self.dim} dimensions returned shape {part.shape}")
        return np.concatenate(out) if out else np.zeros((0, self.dim))


def hashed_projection(dim: int = 64, max_tokens: int = 8192) -> Embedder:
    """A deterministic embedder without a model: each distinct lower-case word adds or takes one at the place that its MD5 names; vectors have length 1 (or 0)."""

    def func(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in set(t.lower().split()):
                h = hashlib.md5(w.encode()).digest()
                out[i, int.from_bytes(h[:2], "big") % dim] += 1 - 2 * (h[2] & 1)
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size == 0, 1, size)

    return Embedder(dim, func, max_tokens)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content", vector: str = "vector") -> DataFrame:
    """rows with a vector column: each Arrow batch goes to the embedder in its own bounded batches; null texts have null vectors."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            found = embedder.rows([texts[i] for i in known])
            own: list = [None] * len(texts)
            for i, v in zip(known, found):
                own[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.float64()))], [*b.schema.names, vector])

    from pyspark.sql.types import StructType

    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL(f"`{vector}` array<double>").fields))


def merged(store: DataFrame | None, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The store with each key's incoming row in place of its own; of several incoming rows the last in order (else of the largest hash)."""
    hashed = F.xxhash64(*incoming.columns)
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*incoming.columns), F.struct(F.col(order), hashed) if order else hashed).alias("_r")).select("_r.*")
    return last if store is None else store.join(last.select(key), key, "left_anti").unionByName(last)


class VectorStore:
    """Rows (key, ..., content, vector) as snapshots; an upsert embeds only what is new or has changed."""

    def __init__(self, snapshots: Snapshots, embedder: Embedder, key: str = "id", text: str = "content") -> None:
        self.snapshots, self.embedder, self.key, self.text = snapshots, embedder, key, text

    def read(self) -> DataFrame | None:
        return self.snapshots.read()

    def upsert(self, rows: DataFrame, order: str | None = None, **more) -> int:
        """The snapshot's number with rows (key, ..., content) put under their keys."""
        fresh = merged(None, rows, self.key, order)

        def change(store: DataFrame | None) -> DataFrame:
            if store is None:
                return embedded(fresh, self.embedder, self.text)
            old = store.select(F.col(self.key).alias("_k"), F.col(self.text).alias("_t"), F.col("vector").alias("_v"))
            met = fresh.join(old, F.col(self.key) == F.col("_k"), "left")
            same = F.col("_v").isNotNull() & F.col("_t").eqNullSafe(F.col(self.text))
            kept = met.filter(same).select(*fresh.columns, F.col("_v").alias("vector"))
            new = embedded(met.filter(~same).select(*fresh.columns), self.embedder, self.text)
            return store.join(fresh.select(self.key), self.key, "left_anti").unionByName(kept.unionByName(new))

        return self.snapshots.update(change, **more)

    def upsert_stream(self, stream: DataFrame, checkpoint: str, order: str | None = None) -> None:
        """Every micro-batch of a stream of rows, once: a batch's number stands in its snapshot's pointer, so a replayed batch changes nothing."""

        def batch(df: DataFrame, number: int) -> None:
            latest = self.snapshots.latest()
            if latest and latest[1].get("stream") == checkpoint and latest[1].get("batch", -1) >= number:
                return
            self.upsert(df, order, stream=checkpoint, batch=number)

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


