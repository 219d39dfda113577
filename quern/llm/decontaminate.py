"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts become lower-case words (ASCII punctuation splits them). A first pass over all documents counts the words of the
benchmark; an item's seeds are its 3-grams that are rare by those counts (expected rate per word under ``RARE``, and
always the rarest half). A second pass looks the seeds up in the documents; seeds of one item on neighbouring
diagonals (``MIN_SEEDS`` or more, or one if the item has a single 3-gram) open a window, which Smith-Waterman aligns with the whole item (match 2, mismatch
-1, gap -1), so inserted, dropped and replaced words cost little. score = alignment / (2 x item words).

Scale: documents are never shuffled. The benchmark goes to the tasks in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters on average, each with its own pass, so what is sent is bounded whatever its size. Windows are cut into
strips of a few item lengths and aligned together by numpy, ``CELLS`` words at once, so a long repetitive text takes no more memory.

Edge cases: null and empty texts and items and items under three words match nothing; rows with a null doc_id are
reported with it; repeated documents give repeated rows; repeated items count once; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, checkpointed, text_key, text_slices, texts

N = 3
RARE = 1e-7
MIN_SEEDS = 2
#: Diagonals of one window differ by at most this much from the next.
SLACK = 12
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Words of the windows that are aligned together, padding included.
CELLS = 200_000
#: Meetings of places with postings that are held at once.
MEETINGS = 2_000_000
#: Pairs below this score are not reported.
REPORT = 0.35
#: A document is contaminated at this score, or with RUN_WORDS aligned words net of edits.
CONTAMINATED = 0.5
RUN_WORDS = 13
_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes(b if b in _KEEP else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: letters, digits and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


class Items:
    """One block of the benchmark: vocabulary and items as ids (0: a word of no item)."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for item, text in rows:
            w = words_of(text)
            if len(w) >= N:
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64))
        self.size = len(self.vocab) + 1

    def grams(self, seq: np.ndarray) -> np.ndarray:
        """Keys of the 3-grams of an id sequence; -1 where a word is of no item."""
        a, b, c = seq[:-2], seq[1:-1], seq[2:]
        key = (a * self.size + b) * self.size + c
        key[(a == 0) | (b == 0) | (c == 0)] = -1
        return key

    def seed(self, counts: np.ndarray, total: int) -> None:
        """Choose the seeds by word counts and index them: sorted keys, and postings (item, offset) of each."""
        rate = np.log((counts + 0.5) / (total + 1.0))
        keys, items, offsets = [], [], []
        for k, w in enumerate(self.words):
            g = self.grams(w)
            cost = rate[w[:-2]] + rate[w[1:-1]] + rate[w[2:]]
            rare = cost <= max(np.log(RARE), np.median(cost))
            at = np.flatnonzero(rare)
            keys.append(g[at])
            items.append(np.full(len(at), k))
            offsets.append(at)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(key))
        self.items = (np.concatenate(items) if items else np.zeros(0, np.int64))[order]
        self.offsets = (np.concatenate(offsets) if offsets else np.zeros(0, np.int64))[order]
        # (seed, item) of each posting as one number, ascending
        self.posted = np.repeat(np.arange(len(self.keys)), np.diff(self.first)) * len(self.words) + self.items
        self.needed = np.array([min(MIN_SEEDS, len(w) - N + 1) for w in self.words], np.int64)


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each window with its item: best scores, and the window index where each best one ends."""
    wide, tall = max(map(len, windows)), max(map(len, items))
    w = np.zeros((len(windows), wide), np.int64)
    v = np.full((len(items), tall), -1, np.int64)
    for k, (x, y) in enumerate(zip(windows, items)):
        w[k, : len(x)] = x
        v[k, : len(y)] = y
    steps = np.arange(wide, dtype=np.int32)
    row = np.zeros((len(windows), wide), np.int32)
    best, at = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for i in range(tall):
        diag = np.zeros_like(row)
        diag[:, 1:] = row[:, :-1]
        diag += np.where(w == v[:, i : i + 1], 2, -1).astype(np.int32)
        new = np.maximum(np.maximum(diag, row - 1), 0)
        new = np.maximum(new, np.maximum.accumulate(new + steps, axis=1) - steps)
        new[v[:, i] < 0] = 0
        top = new.argmax(axis=1)
        score = new[np.arange(len(new)), top]
        up = score > best
        best[up], at[up] = score[up], top[up]
        row = new
    return best, at


def _sequences(ts: list[str], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """One id sequence of many texts, two zeros after each, and where each text begins."""
    get, flat, starts, at = vocab.get, [], [], 0
    for t in ts:
        w = words_of(t)
        flat += [get(x, 0) for x in w]
        flat += (0, 0)
        starts.append(at)
        at += len(w) + 2
    return np.array(flat, np.int64), np.array([*starts, at], np.int64)


def _chains(at: np.ndarray, lo: np.ndarray, n: np.ndarray, starts: np.ndarray, block: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first diagonal, last diagonal) of each run of near diagonals with the seeds that its item needs, of the n postings from lo on that each place meets."""
    post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    pos = np.repeat(at, n)
    if not len(pos):
        return
    item = block.items[post]
    diag = pos - block.offsets[post]
    doc = np.searchsorted(starts, pos, side="right") - 1
    order = np.lexsort((pos, diag, item, doc))
    doc, item, diag = doc[order], item[order], diag[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > SLACK)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(doc)))
    keep = size >= block.needed[item[head]]
    for h, t in zip(head[keep].tolist(), (head + size - 1)[keep].tolist()):
        yield int(doc[h]), int(item[h]), int(diag[h]), int(diag[t])


def find(ts: list[str], block: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(text index, item index, score, aligned words, first word, last word) of each pair at REPORT or above."""
    seq, starts = _sequences(ts, block.vocab)
    if len(seq) < N or not len(block.keys):
        return []
    g = block.grams(seq)
    at = np.flatnonzero(g >= 0)
    where = np.minimum(np.searchsorted(block.keys, g[at]), len(block.keys) - 1)
    ok = block.keys[where] == g[at]
    at, where = at[ok], where[ok]
    if not len(at):
        return []
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    spans = []
    # a seed that many items share meets every place it stands at, so ranges of items are taken one after the other
    total = int((block.first[where + 1] - block.first[where]).sum())
    parts = -(-total // MEETINGS)
    size = -(-len(block.words) // max(parts, 1))
    for begin in range(0, len(block.words), size):
        lo = np.searchsorted(block.posted, where * len(block.words) + begin)
        n = np.searchsorted(block.posted, where * len(block.words) + min(begin + size, len(block.words))) - lo
        for doc, k, low, high in _chains(at, lo, n, starts, block):
            length = len(block.words[k])
            a = max(int(starts[doc]), low - SLACK)
            z = min(int(starts[doc + 1]) - 2, high + length + SLACK)
            spans += [(doc, k, x, y) for x, y in strips(a, z, length)]
    for rows in batches_of(spans, block):
        windows = [seq[a:z] for _, _, a, z in rows]
        items = [block.words[k] for _, k, _, _ in rows]
        score, end = align(windows, items)
        back, begin = align([x[::-1] for x in windows], [x[::-1] for x in items])
        for (d, k, a, z), s, e, b in zip(rows, score.tolist(), end.tolist(), begin.tolist()):
            share = s / (2 * len(block.words[k]))
            if share >= REPORT or s >= 2 * RUN_WORDS:
                got = (share, s // 2, z - 1 - b - int(starts[d]), a + e - int(starts[d]))
                if (d, k) not in best or got > best[d, k]:
                    best[d, k] = got
    return [(d, k, *got) for (d, k), got in sorted(best.items())]


def strips(a: int, z: int, length: int) -> list[tuple[int, int]]:
    """A window in overlapping strips: an alignment with an item of so many words spans 3 times as many at most (each gap costs half a
    match), and every such span lies in one strip whole."""
    if z - a <= 8 * length:
        return [(a, z)]
    return [(x, min(x + 6 * length, z)) for x in range(a, max(a + 1, z - 3 * length), 3 * length)]


def batches_of(spans: list[tuple], block: Items) -> Iterator[list[tuple]]:
    """The windows by size, so many at once that their padded table has CELLS cells at most, one at least."""
    spans = sorted(spans, key=lambda s: (max(s[3] - s[2], len(block.words[s[1]])), s))
    rows: list[tuple] = []
    for s in spans:
        if rows and (len(rows) + 1) * max(s[3] - s[2], len(block.words[s[1]])) > CELLS:
            yield rows
            rows = []
        rows.append(s)
    if rows:
        yield rows


def _count_words(docs: DataFrame, block: Items) -> tuple[np.ndarray, int]:
    """How often the documents have each word of the block, and their words in all."""
    vocab, size = block.vocab, block.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for lo, hi in text_slices(b.column(0)):
                seq, starts = _sequences(texts(b.column(0).slice(lo, hi - lo)), vocab)
                counts += np.bincount(seq, minlength=size)
                counts[0] -= 2 * (len(starts) - 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r.word] = r.n
    return counts, int(counts.sum())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, score, aligned_words, first_word, last_word, contaminated) of every aligned pair."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    found = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = Items([(r.item_id, r.text) for r in own])
        block.seed(*_count_words(src, block))

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column("text")
                for lo, hi in text_slices(col):
                    hits = find(texts(col.slice(lo, hi - lo)), block)
                    if hits:
                        at = pa.array([lo + h[0] for h in hits], pa.int64())
                        cols = [b.column("doc_id").take(at), b.column("th").take(at), pa.array([block.ids[h[1]] for h in hits], pa.int64())]
                        cols += [pa.array([h[i] for h in hits], kind) for i, kind in ((2, pa.float64()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()))]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "item_id", "score", "aligned_words", "first_word", "last_word"])

        part = src.mapInArrow(run, "doc_id long, th long, item_id long, score double, aligned_words int, first_word int, last_word int")
        found = part if found is None else found.union(part)
    return found.withColumn("contaminated", (F.col("score") >= CONTAMINATED) | (F.col("aligned_words") >= RUN_WORDS))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a contaminated pair; rows with a null doc_id go by their text."""
    bad = checkpointed(contaminated(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    src, names = by_place(docs)
    own, text = src[f"_c{names.index('doc_id')}"], f"_c{names.index('text')}"
    met = src.join(bad, own.cast("long").eqNullSafe(F.col("_id")) & (text_key(text) == F.col("_th")), "left_anti")
    return met.toDF(*names)
