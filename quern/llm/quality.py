"""Quality classifier on random-indexing word vectors.

Every token bucket has a fixed sparse random index vector. One pass over all documents adds the index vectors of the neighbours (``REACH`` on each
side) to a token's context vector; the sums are exact corpus statistics. A document is pooled as the means of its tokens' normalised context vectors and index vectors, the length of
the latter mean (repetition shortens variety, so it grows), the agreement of neighbouring tokens, and the log of the
length. A two-layer numpy network on the pooled vectors gives a logit, and a temperature fitted on labels apart from the
network's turns it into calibrated probabilities.

Labels are learned from at most ``SAMPLE`` labelled rows that are not held out (smallest hash first, a documented bound);
context vectors use all documents and scoring reads every whole text. Model arrays have a fixed size.

Edge cases: null and empty texts are pooled as zeros and get that score; without labels of both kinds every score is the base
rate (0.5 without any); repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_sums, text_key, text_slices, texts
from .toxicity import first_rows, labelled

SAMPLE = 4000
BUCKETS = 1 << 14
DIM = 32
SPARSE = 4
REACH = 2
HIDDEN = 24
#: Buckets whose context vectors travel together.
BLOCK = 64
MEMO = 400_000
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+|_+")
_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(0, DIM, (BUCKETS, SPARSE))
_SIGN = _rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, SPARSE))


def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(SPARSE):
        np.add.at(out, (np.arange(BUCKETS), _PLACE[:, k]), _SIGN[:, k] / np.sqrt(SPARSE))
    return out


class Tokens:
    """Token to bucket, memoised in a bounded table."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for w in _TOKEN.findall(text):
            i = memo.get(w)
            if i is None:
                i = memo[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "replace"), 1) % BUCKETS
            out.append(i)
        return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of the neighbours' index vectors over all documents, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums, part = Tokens(), np.zeros(BUCKETS * DIM), 0
        for b in batches:
            for lo, hi in text_slices(b.column(0)):
                flat: list[int] = []
                for t in texts(b.column(0).slice(lo, hi - lo)):
                    flat += tokens.ids(t)
                    flat += [-1] * REACH
                part = (part * 31 + len(flat)) & 0x7FFFFFFF
                seq = np.array(flat, np.int64)
                for step in range(1, REACH + 1):
                    a, z = seq[:-step], seq[step:]
                    ok = (a >= 0) & (z >= 0)
                    a, z = a[ok], z[ok]
                    for own, other in ((a, z), (z, a)):
                        for k in range(SPARSE):
                            sums += np.bincount(own * DIM + _PLACE[other, k], weights=_SIGN[other, k], minlength=BUCKETS * DIM)
        blocks = sums.astype(np.float32).reshape(-1, BLOCK * DIM)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), part), pa.int32()), pa.array([blocks[i].tobytes() for i in at], pa.binary())], ["block", "part", "vec"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "block int, part int, vec binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.float32)
    for block, vec in block_sums(parts, BUCKETS // BLOCK).items():
        out[block] = vec
    return out.reshape(BUCKETS, DIM)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """(BUCKETS, 2 DIM): normalised context vector (the mean direction removed) and index vector."""
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    unit = np.divide(contexts, norm, out=np.zeros_like(contexts), where=norm > 0)
    seen = norm[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(axis=0)
    return np.hstack([unit, index_vectors()]).astype(np.float32)


def pooled(ts: list[str], vectors: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Feature rows of texts."""
    out = np.zeros((len(ts), 2 * DIM + 3), np.float32)
    for k, t in enumerate(ts):
        ids = np.array(tokens.ids(t), np.int64)
        n = len(ids)
        if not n:
            continue
        total, agree = np.zeros(2 * DIM), 0.0
        for lo in range(0, n, 1 << 15):
            v = vectors[ids[lo : lo + (1 << 15) + 1]]
            total += v[: 1 << 15].sum(axis=0)
            agree += float((v[:-1, DIM:] * v[1:, DIM:]).sum())
        mean = total / n
        out[k, : 2 * DIM] = mean
        out[k, 2 * DIM :] = (np.linalg.norm(mean[DIM:]), agree / max(1, n - 1), np.log1p(n) / 10)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-z[:, 0].astype(np.float64) / self.temperature))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """Two-layer network by full-batch Adam on four fifths of the rows; temperature on the others."""
    width = 2 * DIM + 3
    base = float(y.mean()) if len(y) else 0.5
    prior = np.log((base + 1e-3) / (1 - base + 1e-3))
    if len(np.unique(y)) < 2:
        flat = [np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.array([prior])]
        return Model(vectors, np.zeros(width), np.ones(width), flat, 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.array([prior])]
    apart = np.arange(len(x)) % 5 == 4
    if len(np.unique(y[apart])) < 2:
        apart[:] = False
    xs = ((x - shift) / scale).astype(np.float64)
    a, t = xs[~apart], y[~apart].astype(np.float64)[:, None]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, 501):
        h = np.tanh(a @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(t)
        dh = d @ p[2].T * (1 - h * h)
        grads = [a.T @ dh + 2e-4 * p[0], dh.sum(axis=0), h.T @ d + 2e-4 * p[2], d.sum(axis=0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    held = apart if apart.any() else np.ones(len(x), bool)
    z = (np.tanh(xs[held] @ p[0] + p[1]) @ p[2] + p[3])[:, 0]
    grid = np.exp(np.linspace(-1.0, 2.0, 61))
    loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / s).mean() for s in grid]
    return Model(vectors, shift, scale, p, float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Word vectors of all documents, and the network on labelled rows, which the tasks send as feature rows."""
    vectors = word_vectors(context_vectors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            x = pooled(texts(b.column("text")), vectors, tokens)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([v.tobytes() for v in x], pa.binary()), b.column("_y")], ["doc_id", "th", "x", "_y"])

    rows = first_rows(labelled(docs, labels, label, SAMPLE).mapInArrow(run, "doc_id long, th long, x binary, _y int"), SAMPLE)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(len(rows), 2 * DIM + 3)
    return train(x, np.array([r._y for r in rows], np.int64), vectors)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            col = b.column("text")
            for lo, hi in text_slices(col):
                s = model.score(pooled(texts(col.slice(lo, hi - lo)), model.vectors, tokens))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(s)], ["doc_id", "th", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, score double")
