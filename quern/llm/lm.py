"""Language-model scoring by masked pseudo-likelihood.

Words are counted over all documents. The ``TOP`` most frequent ones are the model's words and the others share ``REST`` hash
buckets; a bucket's probability is split among its words by their own corpus counts: those of the ``KNOWN`` next frequent words go to the
tasks, all others are joined from the whole count table. A
window network predicts each token from ``REACH`` words on both sides: embeddings, one tanh layer, and a two-level softmax over classes
and words in a class. It is trained in numpy on all tokens of all documents: each task walks its documents from the shared weights with
Adagrad steps on masked positions (one in ``ROUNDS``, by place, other places in the next round, so that every position is predicted
once), and the tasks' weights are averaged by their number of steps, in ``ROUNDS`` rounds. Tasks get ``TASK_TOKENS`` tokens or more, as
short walks teach little. A document's score is the sum over all its tokens of log P(token | both sides), and its mean.

Scale: the counts are partially aggregated in the tasks; what tasks send for the average grows with the number of tasks
and is added up in a tree (common.block_sums); the weights have a fixed size (0.9 MB), as has the list of known words (``KNOWN`` at most). The counts of rarer words
meet their places in a shuffle join by word hash; no such word can hold more than one in ``TOP`` + 1 of all tokens, so the join has no hot key.
The network meets the rows of a batch in order of their classes, ``ROWS`` at once, so that logits stay in a CPU's cache.

Edge cases: null and empty texts have no tokens, sum 0 and mean null; repeated rows get equal scores; one word has
padding on both sides; an empty table gives an empty result; other columns are ignored, whatever their names; texts of any length are
cut into batches. Sums are added in the order of arrival, so scores are rounded to ``DIGITS`` places and may still differ in the last one between runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import ascii_lower, block_sums, checkpointed, list_array, raw_texts, text_key, text_slices

TOP = 3072
REST = 1024
CLASSES = 64
SIZE = TOP + REST
INNER = SIZE // CLASSES
REACH = 2
EMBED = 16
HIDDEN = 32
ROUNDS = 2
#: Rows of a gradient step, and of a scoring batch.
STEP, BATCH = 8192, 65536
#: Rows whose logits are in memory at once.
ROWS = 2048
RATE = 0.16
#: Tokens that a training task has at least, where the corpus allows.
TASK_TOKENS = 2_000_000
#: Logits are clipped to this size.
LIMIT = np.float32(60)
DIGITS = 6
MEMO = 400_000
#: Words after the model's whose corpus counts go to the tasks; those of all others are joined.
KNOWN = 65_536
#: Floats of the weights that travel together.
BLOCK = 1024
_SHAPES = ((SIZE + 1, EMBED), (2 * REACH * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, INNER), (CLASSES, INNER))


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash, as the SQL function xxhash64 gives it for a binary value; never an id of the model."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Ids of the buckets of word hashes."""
    return TOP + (hashes & (REST - 1))  # REST is a power of two


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for lo, hi in text_slices(b.column(0)):
                for raw in raw_texts(b.column(0).slice(lo, hi - lo)):
                    counts.update(ascii_lower(raw).split())
                if len(counts) > MEMO:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _level() -> Column:
    return F.floor(F.log2("n") * 16)


def histogram(counts: DataFrame) -> list[Row]:
    """(b, k): number of words k in each step b of the counts, 16 steps an octave, highest first."""
    return sorted(counts.groupBy(_level().alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.b)


def vocabulary(counts: DataFrame, steps: list[Row] | None = None) -> tuple[dict[bytes, int], np.ndarray]:
    """Model words with ids by frequency (ties by word), and the occurrences of every id, from the whole word counts."""
    # the histogram finds where the top begins, so that tasks send little besides it
    need, least = TOP, 0
    for r in histogram(counts) if steps is None else steps:
        least, need = r.b, need - r.k
        if need <= 0:
            break
    rows = counts.filter(_level() >= least).orderBy(F.desc("n"), "word").limit(TOP).collect()
    top = {bytes(r.word): i for i, r in enumerate(rows)}
    uses = np.zeros(SIZE, np.int64)
    uses[: len(rows)] = [r.n for r in rows]
    # words of the model count in no bucket: what they add to theirs is taken off again
    for r in counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(REST)).alias("b")).agg(F.sum("n").alias("n")).collect():
        uses[TOP + r.b] = r.n
    for w, i in top.items():
        uses[TOP + word_hash(w) % REST] -= uses[i]
    return top, uses


def known_words(counts: DataFrame, steps: list[Row], top: dict[bytes, int]) -> dict[bytes, float]:
    """Log corpus counts of the most frequent words outside the model: KNOWN at most, as whole steps of the histogram, so that ties stay together."""
    room, least = TOP + KNOWN, None
    for r in steps:
        room -= r.k
        if room < 0:
            break
        least = r.b
    if least is None:
        return {}
    rows = counts.filter((_level() >= least) & (F.col("n") > 1)).select("word", F.log("n").alias("worth")).collect()
    return {w: r.worth for r in rows if (w := bytes(r.word)) not in top}


class Reader(dict):
    """Texts to codes: the id of a word of the model, SIZE and more for the known words in their order, the hash of any other."""

    def __init__(self, top: dict[bytes, int], known: Iterable[bytes] = ()) -> None:
        super().__init__(top)
        self.update((w, SIZE + k) for k, w in enumerate(known))

    def __missing__(self, word: bytes) -> int:
        return word_hash(word)  # not kept: a hash costs less than finding its word among all rare ones

    def codes(self, raw: bytes) -> np.ndarray:
        words = ascii_lower(raw).split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def start(uses: np.ndarray) -> list[np.ndarray]:
    """Random weights; the output biases begin at the corpus frequencies."""
    rng = np.random.default_rng(11)
    out = []
    for shape in _SHAPES:
        fan = shape[-2] if len(shape) > 1 else 0
        spread = 0.0 if not fan else 0.3 if shape[0] == SIZE + 1 else 1 / np.sqrt(fan)
        out.append(rng.normal(0, 1, shape).astype(np.float32) * np.float32(spread))
    own = np.log(uses + 1.0).reshape(INNER, CLASSES).T  # row c: the ids c, c + CLASSES, ...
    top = own.max(axis=1, keepdims=True)
    out[6][:] = own - top
    whole = (top + np.log(np.exp(own - top).sum(axis=1, keepdims=True)))[:, 0]
    out[4][:] = whole - whole.max()
    out[3] *= 0.1
    out[5] *= 0.1
    return out


def flat(weights: list[np.ndarray]) -> np.ndarray:
    v = np.concatenate([w.ravel() for w in weights])
    return np.pad(v, (0, -len(v) % BLOCK))


def unflat(v: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(v[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return out


def windows(ids: np.ndarray) -> np.ndarray:
    """Context ids of each place, SIZE as padding: (n, 2 REACH)."""
    p = np.concatenate([np.full(REACH, SIZE, np.int32), ids, np.full(REACH, SIZE, np.int32)])
    n = len(ids)
    return np.stack([p[k : k + n] for k in range(2 * REACH + 1) if k != REACH], axis=1)


def _hidden(w: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.take(w[0], ctx, axis=0).reshape(len(ctx), -1)  # many times faster than indexing by rows
    h = x @ w[1]
    h += w[2]
    return x, np.tanh(h, out=h)


def _passes_limit(w: list[np.ndarray]) -> bool:
    """Whether a logit can be larger than LIMIT at all, as hidden units lie between -1 and 1."""
    return not max(float((np.abs(m).sum(axis=-2) + np.abs(b)).max()) for m, b in ((w[3], w[4]), (w[5], w[6]))) < LIMIT


def _clipped(z: np.ndarray, clip: bool) -> np.ndarray:
    return np.clip(z, -LIMIT, LIMIT, out=z) if clip else z


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, list[tuple[int, int, int]]]]]:
    """Order of the rows by class, and blocks (from, to, parts) of it: small enough for a CPU's cache, with parts (class, from, to) from the block's begin."""
    c = (target % CLASSES).astype(np.uint8)  # one byte: sorted in linear time
    ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=CLASSES))]).tolist()
    blocks = [(lo, min(lo + ROWS, len(target)), []) for lo in range(0, len(target), ROWS)]
    for k in range(CLASSES):
        a = ends[k]
        while a < ends[k + 1]:
            lo, hi, parts = blocks[a // ROWS]
            b = min(ends[k + 1], hi)
            parts.append((k, a - lo, b - lo))
            a = b
    return np.argsort(c, kind="stable"), blocks


def _logits(w: list[np.ndarray], h: np.ndarray, parts: list[tuple[int, int, int]], clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the classes, and of the words in the class of each row."""
    z, s = h @ w[3], np.empty((len(h), INNER), np.float32)
    z += w[4]
    for c, a, b in parts:
        np.matmul(h[a:b], w[5][c], out=s[a:b])
        s[a:b] += w[6][c]
    return _clipped(z, clip), _clipped(s, clip)


def log_probabilities(w: list[np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | context) of each row."""
    clip = _passes_limit(w)
    order, blocks = _by_class(target)
    ctx, target = np.take(ctx, order, axis=0), target[order]
    out, part = np.empty(len(target)), np.empty(len(target))
    for lo, hi, parts in blocks:
        t = target[lo:hi]
        logits = _logits(w, _hidden(w, ctx[lo:hi])[1], parts, clip)
        own = [z.ravel()[np.arange(0, z.size, z.shape[1]) + at] for z, at in zip(logits, (t % CLASSES, t // CLASSES))]
        part[lo:hi] = sum(x - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)) for x, z in zip(own, logits))
    out[order] = part
    return out


def _errors(z: np.ndarray, at: np.ndarray, n: np.float32) -> None:
    """Logits to gradients of the mean loss of n rows by them, in place."""
    np.exp(z, out=z)
    z *= (1 / n / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z.ravel()[np.arange(0, z.size, z.shape[1]) + at] -= 1 / n


def gradients(w: list[np.ndarray], ctx: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean negative log-likelihood of a batch, in the order of the weights."""
    n, clip = np.float32(len(target)), _passes_limit(w)
    order, blocks = _by_class(target)
    ctx, target = np.take(ctx, order, axis=0), target[order]
    out = [np.zeros_like(x) for x in w]
    # what each entry of the embeddings gets lies side by side
    by_entry = w[1].reshape(2 * REACH, EMBED, HIDDEN).transpose(1, 0, 2).reshape(-1, HIDDEN)
    dp = np.empty((len(target), HIDDEN), np.float32)
    for lo, hi, parts in blocks:
        t, ones = target[lo:hi], np.ones(hi - lo, np.float32)
        x, h = _hidden(w, ctx[lo:hi])
        z, s = _logits(w, h, parts, clip)
        _errors(z, t % CLASSES, n)
        _errors(s, t // CLASSES, n)
        dh = np.matmul(z, w[3].T, out=dp[lo:hi])
        for c, a, b in parts:
            dh[a:b] += s[a:b] @ w[5][c].T
            out[5][c] += h[a:b].T @ s[a:b]
            out[6][c] += ones[: b - a] @ s[a:b]
        out[3] += h.T @ z
        out[4] += ones @ z
        np.multiply(h, h, out=h)
        dh *= np.subtract(1, h, out=h)
        out[1] += x.T @ dh
        out[2] += ones @ dh
    at = ctx.T.astype(np.intp).ravel()
    for k, d in enumerate((by_entry @ dp.T).reshape(EMBED, -1)):
        out[0][:, k] = np.bincount(at, weights=d, minlength=SIZE + 1)
    return out


def step(w: list[np.ndarray], past: list[np.ndarray], ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step in place; past: sums of squared gradients."""
    for x, p, g in zip(w, past, gradients(w, ctx, target)):
        p += g * g
        g *= np.float32(rate)
        g /= np.sqrt(p)
        x -= g


def _source(docs: DataFrame) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return src.withColumn("row_key", F.xxhash64("doc_id", "th"))


def sequences(docs: DataFrame, top: dict[bytes, int], known: dict[bytes, float] | None = None) -> DataFrame:
    """(doc_id, th, row_key, ids, known, rare): every text as 16-bit ids in a binary column, the sum of log corpus count over its known
    words, and the hashes of its words that are neither known nor of the model."""
    known = known or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(top, known)
        own_bucket = buckets(np.array([word_hash(w) for w in known], np.int64))
        own_worth = np.array(list(known.values()), float)
        for b in batches:
            col = b.column("text")
            for lo, hi in text_slices(col):
                codes = [reader.codes(r) for r in raw_texts(col.slice(lo, hi - lo))]
                n = np.array([len(c) for c in codes])
                flat = np.concatenate(codes)
                other = (flat < 0) | (flat >= TOP)
                ids = np.where(other, buckets(flat), flat).astype(np.uint16)
                met = np.flatnonzero((flat >= SIZE) & (flat < SIZE + len(known)))
                which = flat[met] - SIZE
                ids[met], other[met] = own_bucket[which], False
                worth = np.bincount(np.repeat(np.arange(len(n)), n)[met], weights=own_worth[which], minlength=len(n))
                ids = ids.tobytes()
                ends = np.concatenate([[0], np.cumsum(n)])
                rare = np.concatenate([[0], np.cumsum(other)])[ends]
                own = [ids[2 * x : 2 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "th", "row_key")), pa.array(own, pa.binary()), pa.array(worth.astype(float)), list_array(flat[other], np.diff(rare), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "row_key", "ids", "known", "rare"])

    return _source(docs).mapInArrow(run, "doc_id long, th long, row_key long, ids binary, known double, rare array<long>")


def rare_sums(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_key, worth): for every text the sum of log corpus count over its rare words."""
    places = coded.select("row_key", F.explode("rare").alias("word"))
    worth = counts.filter("n > 1").select(F.xxhash64("word").alias("word"), F.log("n").alias("worth"))
    met = places.join(worth, "word").select("row_key", "worth", F.lit(0).alias("copies"))
    # rows of one text and doc_id share a key: their number takes the sum back to one of them
    every = met.union(coded.select("row_key", F.lit(0.0), F.lit(1)))
    sums = every.groupBy("row_key").agg(F.sum("worth").alias("worth"), F.sum("copies").alias("copies"))
    return sums.select("row_key", (F.col("worth") / F.col("copies")).alias("worth"))


def read_ids(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int32) if x.is_valid else np.zeros(0, np.int32) for x in col]


def masked(n: int, turn: int) -> slice:
    """The places of a text of n tokens that a round predicts; the rounds together predict each place once. Texts of even
    and odd length begin apart, so that no round sees one kind of place only."""
    return slice((turn + n) % ROUNDS, None, ROUNDS)


def train(coded: DataFrame, uses: np.ndarray) -> list[np.ndarray]:
    """ROUNDS of local training on all documents (as sequences) and weighted averaging."""
    tasks = max(1, int(uses.sum()) // TASK_TOKENS)
    src = coded.select("ids").coalesce(tasks)
    weights = start(uses)
    blocks = len(flat(weights)) // BLOCK
    for turn in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], begin: list[np.ndarray] = weights, turn: int = turn) -> Iterator[pa.RecordBatch]:
            w, steps, part = [x.copy() for x in begin], 0, 0
            past = [np.full_like(x, 1e-8) for x in begin]
            ctxs: list[np.ndarray] = []
            targets: list[np.ndarray] = []
            held = 0
            for b in batches:
                for ids in read_ids(b.column(0)):
                    part = (part * 31 + len(ids)) & 0x7FFFFFFF
                    ctxs.append(windows(ids)[masked(len(ids), turn)])
                    targets.append(ids[masked(len(ids), turn)])
                    held += len(targets[-1])
                    while held >= STEP:
                        c, t = np.concatenate(ctxs), np.concatenate(targets)
                        step(w, past, c[:STEP], t[:STEP], RATE / (1 + turn))
                        steps += 1
                        ctxs, targets, held = [c[STEP:]], [t[STEP:]], len(t) - STEP
            if held:
                step(w, past, np.concatenate(ctxs), np.concatenate(targets), RATE / (1 + turn) * held / STEP)
                steps += held / STEP
            if steps:
                v = flat(w) * np.float32(steps)
                rows = [(i, v[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(blocks)] + [(blocks, np.array([steps], np.float32).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "part", "vec"])

        sums = block_sums(src.mapInArrow(run, "block int, part int, vec binary"), blocks + 1)
        if sums:
            steps = float(sums[blocks][0])
            weights = unflat(np.concatenate([sums[i] for i in range(blocks)]) / steps)
    return weights


def score_text(ids: np.ndarray, w: list[np.ndarray], share: np.ndarray) -> float:
    """Sum of the log-probabilities of all tokens; share: log of the occurrences that each id's words have together, 0 for words of the model."""
    if not len(ids):
        return 0.0
    total = 0.0
    for lo in range(0, len(ids), BATCH):
        t = ids[lo : lo + BATCH]
        front = max(0, lo - REACH)
        ctx = windows(ids[front : lo + BATCH + REACH])[lo - front : lo - front + len(t)]
        total += float((log_probabilities(w, ctx, t) - share[t]).sum())
    return total


def _score_slice(seqs: list[np.ndarray], w: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """score_text of many texts in shared batches."""
    n = np.array([len(s) for s in seqs])
    sums = np.zeros(len(seqs) + 1)
    if n.sum():
        row = np.repeat(np.arange(len(seqs)), n)
        ids = np.concatenate(seqs)
        ctx = np.concatenate([windows(s) for s in seqs])
        for lo in range(0, len(ids), BATCH):
            own = ids[lo : lo + BATCH]
            sums += np.bincount(row[lo : lo + BATCH], weights=log_probabilities(w, ctx[lo : lo + BATCH], own) - share[own], minlength=len(sums))
    return sums[:-1]


def _groups(n: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many tokens, one row at least."""
    lo, held = 0, 0
    for k, x in enumerate(n):
        if held and held + x > most:
            yield lo, k
            lo, held = k, 0
        held += x
    if lo < len(n):
        yield lo, len(n)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_tokens, sum_logprob, mean_logprob) of every document by a model of all documents."""
    counts = checkpointed(word_counts(docs))
    steps = histogram(counts)
    top, uses = vocabulary(counts, steps)
    coded = checkpointed(sequences(docs, top, known_words(counts, steps, top)))
    weights = train(coded, uses)
    share = np.concatenate([np.zeros(TOP), np.log(np.maximum(1, uses[TOP:]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_buffer()) // 2 if x.is_valid else 0 for x in b.column("ids")]
            for lo, hi in _groups(sizes):
                part = b.slice(lo, hi - lo)
                n = np.array(sizes[lo:hi], np.int32)
                seqs = read_ids(part.column("ids"))
                one = hi - lo == 1 and n[0] > BATCH  # a very long text: its contexts are made batch by batch
                sums = np.array([score_text(seqs[0], weights, share)]) if one else _score_slice(seqs, weights, share)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "th", "row_key", "known")), pa.array(n), pa.array(sums)], ["doc_id", "th", "row_key", "known", "n_tokens", "net"])

    net = coded.mapInArrow(run, "doc_id long, th long, row_key long, known double, n_tokens int, net double")
    whole = F.col("net") + F.col("known") + F.coalesce("worth", F.lit(0.0))
    met = net.join(rare_sums(coded, counts), "row_key", "left")
    mean = F.when(F.col("n_tokens") > 0, F.round(whole / F.col("n_tokens"), DIGITS))
    return met.select("doc_id", "th", "n_tokens", F.round(whole, DIGITS).alias("sum_logprob"), mean.alias("mean_logprob"))
