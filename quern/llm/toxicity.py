"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel compares words by the subsequences of three letters that they share, gapped ones discounted by ``DECAY``
for each letter skipped (``SPAN`` letters at most), so words with inserted characters stay close to their clean
forms. Letters are folded first: case, accents, digits and signs that stand for letters; letters of other scripts become one
of ``FOREIGN`` symbols by code point; other characters between letters drop out, and single letters set apart by spaces are joined. Landmarks are words of the labelled sentences: those that set toxic documents apart and
the clean words nearest to them. The SVM works on the landmarks' whitened kernel values (Nystroem); a
sentence's decision is that of its strongest word, and the words that train it are chosen again after each round
(multiple-instance learning from document labels). As the kernel has a finite feature space, landmarks and weights fold
into one tensor of 28^3 numbers, exactly, so scoring a word costs its own subsequences only, whatever the number of landmarks.
A logistic layer turns a document's strongest word and number of positive words into a calibrated score.

Labels are learned from at most ``SAMPLE`` labelled rows that are not held out (smallest hash first, a documented
bound), of which the tasks send the distinct folded words; scoring reads every whole text. An id with both labels counts as toxic.
Landmarks have four letters or more, as shorter words share subsequences with too many clean ones; they are ``POSITIVE_LANDMARKS`` and
``NEGATIVE_LANDMARKS`` at most, and an SVM round takes ``MOST_POSITIVE`` and 4000 words at most. Where no word tells the classes
apart beyond doubt, the ``FEW`` that do so best serve. Models are small constants, sent with the task closures.

Edge cases: null and empty texts get the score of a text without words; without labels of both kinds all scores
are the base rate (0.5 if there are none); repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, raw_texts, text_key, text_slices

SAMPLE = 4000
SPAN = 6
DECAY = 0.6
POSITIVE_LANDMARKS = 100
NEGATIVE_LANDMARKS = 200
MOST_POSITIVE = 3000
FEW = 20
#: Norm of a short word; shorter ones don't count as more alike for having few subsequences.
LEAST_NORM = 1.6
MEMO = 200_000
#: Decision from which a word counts as a hit.
SURE = 0.8
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = bytearray(range(256))
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
for _a, _z in SIGNS.items():
    _FOLD[ord(_a)] = ord(_z)
_FOLD = bytes(_FOLD)
#: Symbols for letters of other scripts, after the letters, the mark and the gap.
FOREIGN = 8
_FIRST = 128
_KEPT = {*range(97, 123), *range(_FIRST, _FIRST + FOREIGN), 9, 10, 11, 12, 13, 32}
_DROP = bytes(b for b in range(256) if _FOLD[b] not in _KEPT)
_RUN = re.compile(rb"[\x80-\xff]+")
_SPACED = re.compile(rb"(?<!\S)(?:[a-z]\s){3,}[a-z](?!\S)")
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
#: Letters 0-25, the mark in front of each word 26, the gap between words 27, letters of other scripts.
MARK, GAP, BASE = 26, 27, 28 + FOREIGN
DIM = BASE**3


@lru_cache(maxsize=100_000)
def _fold_run(run: bytes) -> bytes:
    """Folded form of neighbouring non-ASCII characters, code point by code point, letters of other scripts as bytes from _FIRST on."""
    out = bytearray()
    for c in run.decode("utf-8", "replace"):
        base = "s" if c == "ß" else unicodedata.normalize("NFKD", c)[0].lower()
        if "a" <= base <= "z":
            out += base.encode()
        elif c.isspace():
            out += b" "
        elif c.isalpha():
            out.append(_FIRST + ord(c) % FOREIGN)
    return bytes(out)


def fold(raw: bytes) -> bytes:
    if not raw.isascii():
        raw = _RUN.sub(lambda m: _fold_run(m.group()) if len(m.group()) < 64 else b"".join(_fold_run(x.encode()) for x in m.group().decode("utf-8", "replace")), raw)
    return raw.translate(_FOLD, _DROP)


def folded_words(raw: bytes) -> list[bytes]:
    """Folded words of a text; a row of four or more single letters also counts as one word."""
    low = fold(raw)
    out = low.split()
    for m in _SPACED.finditer(low):
        out.append(b"".join(m.group().split()))
    return out


_CODE = np.zeros(256, np.int32)
_CODE[97:125] = np.arange(28)
_CODE[_FIRST : _FIRST + FOREIGN] = np.arange(28, BASE)


def _stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of many words (gaps between them, SPAN long, so that no subsequence crosses), and their starts."""
    codes = _CODE[np.frombuffer(b"{" + (b"|" * SPAN + b"{").join(words) + b"|" * SPAN, np.uint8)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + SPAN + 1
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def kernel_sums(words: list[bytes], tensor: np.ndarray) -> np.ndarray:
    """<phi(w), tensor> / |phi(w)| of each word; words under two letters give 0."""
    if not words:
        return np.zeros(0, np.float32)
    codes, starts = _stream(words)
    n = len(codes) - SPAN
    dots, squares = np.zeros(len(codes), np.float32), np.zeros(len(codes), np.float32)
    head = codes[:n] * (BASE * BASE)
    inside = codes[:n] != GAP
    for a, b in _STEPS:
        weight = np.float32(DECAY ** (a + b - 2))
        last = codes[a + b : a + b + n]
        dots[:n] += weight * tensor[head + codes[a : a + n] * BASE + last]
        squares[:n] += weight * weight * ((last != GAP) & inside & (codes[a : a + n] != GAP))
    norm = np.sqrt(np.add.reduceat(squares, starts))
    return np.add.reduceat(dots, starts) / np.maximum(norm, LEAST_NORM)


def features(words: list[bytes]) -> np.ndarray:
    """Rows phi(w) / |phi(w)| in the explicit feature space (training only)."""
    out = np.zeros((len(words), DIM), np.float32)
    for k, w in enumerate(words):
        c = [MARK, *_CODE[list(w)].tolist()]
        total = 0.0
        for i in range(len(c)):
            for a, b in _STEPS:
                if i + a + b < len(c):
                    weight = DECAY ** (a + b - 2)
                    out[k, (c[i] * BASE + c[i + a]) * BASE + c[i + a + b]] += weight
                    total += weight * weight
        out[k] /= max(np.sqrt(total), LEAST_NORM)
    return out


def document_features(top: float, hits: int, size: int) -> list[float]:
    """Of a text: strongest word, number of words at SURE or above, their share, number of distinct words."""
    return [1.0, min(max(top, -2.0), 1.2), np.log1p(hits), np.log1p(100 * hits / size), np.log1p(size), float(hits > 0)]


@dataclass
class Model:
    tensor: np.ndarray
    bias: float
    layer: np.ndarray  # weights of document_features

    def document(self, values: list[float]) -> float:
        """Score of a text from its distinct words' decisions."""
        x = document_features(max(values, default=self.bias), sum(v >= SURE for v in values), max(1, len(values)))
        return float(1 / (1 + np.exp(-np.dot(self.layer, x))))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM by full-batch subgradient steps; classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    mean_w, mean_b = np.zeros_like(w), 0.0
    for t in range(1, rounds + 1):
        active = (y * (x @ w + b) < 1) * weight * y
        step = 2.0 / (1 + 0.02 * t)
        w += step * (cost * (active @ x) - 0.01 * w)
        b += step * active.sum()
        if t > rounds // 2:
            mean_w += w
            mean_b += b
    k = rounds - rounds // 2
    return mean_w / k, mean_b / k


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column of x is the intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
    return w


def variants(word: bytes) -> list[bytes]:
    """Edited forms of a word, by rule: one inserted letter at each inner place, one dropped letter."""
    out = []
    for i in range(1, len(word)):
        out.append(word[:i] + b"xqzjk"[i % 5 : i % 5 + 1] + word[i:])
    return out + [word[: len(word) // 2] + word[len(word) // 2 + 1 :]]


def projected(words: list[bytes], project: np.ndarray, step: int = 200) -> np.ndarray:
    """Nystroem coordinates of words, a few dense feature rows at a time."""
    out = [features(words[lo : lo + step]) @ project.T for lo in range(0, len(words), step)]
    return np.concatenate(out).astype(np.float64)


def train(rows: list[tuple[list[bytes], int]]) -> Model:
    """Fit on (distinct folded words, label) rows."""
    ys = np.array([y for _, y in rows], np.int64)
    base = float(ys.mean()) if len(ys) else 0.5
    flat = Model(np.zeros(DIM, np.float32), -1.0, np.array([np.log((base + 1e-3) / (1 - base + 1e-3)), 0, 0, 0, 0, 0]))
    if len(set(ys.tolist())) < 2:
        return flat
    # bags of word ids: the words of the sentences of each text
    vocab: dict[bytes, int] = {}
    bags = []
    for own, _ in rows:
        bags.append(np.array(sorted(vocab.setdefault(w, len(vocab)) for w in own), np.int32))
    words = list(vocab)
    nt, nc = int(ys.sum()), int((1 - ys).sum())
    every = lambda y: np.concatenate([np.zeros(0, np.int32), *(b for b, v in zip(bags, ys.tolist()) if v == y)])
    toxic, clean = (np.bincount(every(y), minlength=len(words)) for y in (1, 0))
    p, q = (toxic + 0.5) / (nt + 1), (clean + 0.5) / (nc + 1)
    z = (p - q) / np.sqrt(q * (1 - q) / nt + p * (1 - p) / nt)
    long = np.fromiter((len(w) > 3 for w in words), bool, len(words))
    telling = np.flatnonzero((toxic >= 2) & (z > 3) & (p > 4 * q) & long)
    telling = sorted(telling.tolist(), key=lambda i: (-z[i], words[i]))
    if not telling:
        best = np.flatnonzero((p > q) & long)
        telling = sorted(best.tolist(), key=lambda i: (-z[i], words[i]))[:FEW]
    if not telling:  # no words at all
        return flat
    positive = telling[:POSITIVE_LANDMARKS]
    mark = features([words[i] for i in positive])
    pool = sorted(set(np.flatnonzero(clean).tolist()) - set(positive), key=lambda i: words[i])
    near = kernel_sums([words[i] for i in pool], mark.max(axis=0))
    order = np.argsort(-near, kind="stable")
    half = NEGATIVE_LANDMARKS // 2
    negative = list(dict.fromkeys([pool[i] for i in order[:half]] + pool[:: max(1, len(pool) // half)][:half]))
    phi = np.concatenate([mark, features([words[i] for i in negative])])
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    project = (whiten @ phi).astype(np.float32)  # K(x, Z) K_ZZ^-1/2 = phi(x) project^T
    del phi
    # virtual examples: edited forms of the surest words, which sentences to come may hold
    sure = [words[i] for i in positive if z[i] >= 0.6 * z[positive[0]]]
    edited = [v for w in sure for v in variants(w) if v not in vocab or not clean[vocab[v]]]
    tensor, bias = mark.mean(axis=0), -0.5
    f = kernel_sums(words, tensor) + np.float32(bias)
    for turn in range(3):
        good = list(telling)
        if turn:  # witnesses: strongest words of toxic documents that clean ones don't use
            for bag, y in zip(bags, ys.tolist()):
                if y and len(bag):
                    best = bag[np.argsort(-f[bag], kind="stable")[:3]].tolist()
                    good += [i for i in best if f[i] > 0.3 and not clean[i]]
        good = list(dict.fromkeys(good))
        own = list(dict.fromkeys([words[i] for i in good] + edited))[:MOST_POSITIVE]
        bad = np.setdiff1d(np.flatnonzero(clean), good)
        bad = bad[np.argsort(-f[bad], kind="stable")].tolist()
        bad = bad[:2500] + bad[2500 :: max(1, len(bad) // 1500)][:1500]
        x = projected(own + [words[i] for i in bad], project)
        y = np.concatenate([np.ones(len(own)), -np.ones(len(bad))])
        w, bias = _svm(x, y)
        tensor = (w @ project).astype(np.float32)
        f = kernel_sums(words, tensor) + np.float32(bias)
    x = []
    for bag in bags:
        v = f[bag] if len(bag) else np.array([bias])
        x.append(document_features(float(v.max()), int((v >= SURE).sum()), len(v)))
    return Model(tensor, float(bias), _logistic(np.array(x), ys.astype(float)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, th, text, _y) of the rows of at most ``limit`` labelled ids outside the held-out fold, smallest hash first; of
    several labels of an id the largest counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "th", "text", "_y")


def first_rows(rows: DataFrame, limit: int = SAMPLE) -> list:
    """At most ``limit`` rows of what the tasks made of labelled(), in a fixed order."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(limit).collect()


def sentence_words(raw: bytes) -> list[bytes]:
    """Distinct folded words of a text's sentences, sorted."""
    return sorted({w for s in re.split(rb"[.!?\n]+", raw) for w in folded_words(s)})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> list[tuple[list[bytes], int]]:
    """(distinct folded words, label) of labelled()'s rows, folded in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [b" ".join(sentence_words(r)) for r in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(bags, pa.binary()), b.column("_y")], ["doc_id", "th", "words", "_y"])

    rows = labelled(docs, labels, label, limit).mapInArrow(run, "doc_id long, th long, words binary, _y int")
    return [(bytes(r.words).split(), int(r._y)) for r in first_rows(rows, limit)]


def score_texts(raws: list[bytes], model: Model, memo: dict[bytes, float]) -> np.ndarray:
    bags = [set(folded_words(r)) for r in raws]
    new = [w for w in set().union(*bags) if w not in memo]
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = list(set().union(*bags))
    for lo in range(0, len(new), 100_000):
        part = new[lo : lo + 100_000]
        memo.update(zip(part, (kernel_sums(part, model.tensor) + model.bias).tolist()))
    return np.array([model.document([memo[w] for w in bag]) for bag in bags])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for b in batches:
            col = b.column("text")
            for lo, hi in text_slices(col):
                s = score_texts(raw_texts(col.slice(lo, hi - lo)), model, memo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(s)], ["doc_id", "th", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, all columns kept; no shuffle: texts are scored in place."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    at = names.index("text")
    src = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for b in batches:
            for lo, hi in text_slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(score_texts(raw_texts(part.column(at)), model, memo) < threshold))

    return src.mapInArrow(run, src.schema).toDF(*names)
