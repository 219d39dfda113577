"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

Fingerprints are 64-bit SimHashes of 3-word shingles. Links join fingerprints that differ in at most ``radius``
(3) bits. Candidates meet in ten tables: the 64 bits are cut into five blocks, and two fingerprints within three
bits agree on at least two whole blocks, so each pair of blocks is one exact table key (no recall loss).
Inside a bucket, bit planes are stored vertically (one bit of all lanes in one word), distances are counted for
all lanes at once by carry-save counters, and a query is abandoned when every lane has passed the radius.

Scale: equal fingerprints collapse before anything else; buckets with one member never reach Python; a bucket of
more than ``SUB`` members is cut into sub-blocks that meet pairwise, so no task holds a hot bucket; every task
emits a spanning forest (at most one row for each fingerprint that it saw), never all pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts with fewer than three
words use the whole sequence as one shingle; repeated rows get equal results; null ids count after all others (a component
without any id has a null component_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_place, checkpointed, raw_texts, text_key, text_slices

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Members of a sub-block of a bucket.
SUB = 1024
#: Bit ranges [low, high) of the five blocks.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
_CHUNK = 1 << 16


def fingerprint(raw: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = ascii_lower(raw).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return h(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    join = b" ".join
    for lo in range(0, n, _CHUNK):
        part = words[lo : lo + _CHUNK + SHINGLE - 1]
        hs = np.array([h(x, SEED) for x in map(join, zip(part, part[1:], part[2:]))], np.uint64)
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): th tells texts apart, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("text")
            for lo, hi in text_slices(col):
                fps = np.array([fingerprint(x) for x in raw_texts(col.slice(lo, hi - lo))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(fps)], ["doc_id", "th", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, fp long")


class Forest:
    """Union-find over 64-bit ints; roots are the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)

    def rows(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.find(x)) != x]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row p has bit p of every fingerprint, lanes padded to whole bytes."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def within(vertical: np.ndarray, queries: np.ndarray | None, lanes: int) -> np.ndarray:
    """Bit-sliced distance test. vertical: planes of the lanes; queries: fingerprints to compare with every lane, or
    None if the planes hold XORs already. Returns (rows, lanes) booleans: within RADIUS.

    Two carry-save planes count distances 0 to 3 and a sticky plane marks lanes past 3; rows whose lanes are all
    marked are abandoned."""
    width = vertical.shape[1]
    rows = 1 if queries is None else len(queries)
    flips = None
    if queries is not None:
        flips = np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * np.uint8(255)
    pad = np.zeros(width, np.uint8)
    if lanes % 8:
        pad[-1] = (0xFF << (lanes % 8)) & 0xFF
    live = np.arange(rows)
    one = np.zeros((rows, width), np.uint8)
    two = np.zeros_like(one)
    over = np.tile(pad, (rows, 1))
    for p in range(64):
        d = vertical[p][None, :] if flips is None else vertical[p][None, :] ^ flips[live, p][:, None]
        carry = one & d
        one = one ^ d
        over |= two & carry
        two = two ^ carry
        if p % 8 == 7:
            keep = (over != 255).any(axis=1)
            if not keep.all():
                live, one, two, over = live[keep], one[keep], two[keep], over[keep]
                if not len(live):
                    break
    out = np.zeros((rows, lanes), bool)
    if len(live):
        out[live] = np.unpackbits(~over, axis=1, count=lanes, bitorder="little").view(bool)
    return out


def _bucket_links(left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Link every pair of left x right within the radius; queries go in strips so that memory stays bounded.
    Local labels collapse dense buckets before the forest sees them."""
    same = left is right
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(nodes))
    vertical = planes(right)
    for lo in range(0, len(left), 256):
        hit = within(vertical, left[lo : lo + 256], len(right))
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            found = np.unique(np.append(label[np.flatnonzero(hit[i]) + shift], label[lo + i]))
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    named = nodes.view(np.int64).tolist()
    for x, k in enumerate(label.tolist()):
        if x != k:
            forest.link(named[x], named[k])


def _small_links(groups: list[np.ndarray], forest: Forest) -> None:
    """Many small buckets at once: one lane for each pair, planes of the XORs."""
    a = np.concatenate([np.repeat(g, np.arange(len(g) - 1, -1, -1)) for g in groups])
    b = np.concatenate([g[np.concatenate([np.arange(i + 1, len(g)) for i in range(len(g))])] for g in groups])
    hit = within(planes(a ^ b), None, len(a))[0]
    for x, y in zip(a[hit].view(np.int64).tolist(), b[hit].view(np.int64).tolist()):
        forest.link(x, y)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j): compare sub-block i with j. Emits (u, v): a spanning forest of the links."""
    forest, small, pairs = Forest(), [], 0

    def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        arr = np.array(rows, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], ["u", "v"])

    def groups() -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "i", "j", "sub", "fp")]
            n = len(cols[0])
            if not n:
                continue
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), n]):
                k = (cols[0][lo], cols[1][lo], cols[2][lo])
                if held and k != key:
                    yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    held = []
                key = k
                held.append((cols[3][lo:hi], cols[4][lo:hi].astype(np.int64).view(np.uint64)))
        if held:
            yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

    for (_, i, j), sub, fps in groups():
        if i != j:
            left, right = fps[sub == i], fps[sub == j]
            if len(left) and len(right):
                _bucket_links(left, right, forest)
        elif len(fps) > 48:
            _bucket_links(fps, fps, forest)
        elif len(fps) > 1:
            small.append(fps)
            pairs += len(fps) * (len(fps) - 1) // 2
            if pairs > 1 << 16:
                _small_links(small, forest)
                small, pairs = [], 0
        if len(forest.up) > 400_000:
            yield out(forest.rows())
            forest = Forest()
    if small:
        _small_links(small, forest)
    if rows := forest.rows():
        yield out(rows)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) with v < u: a spanning forest, of each task's, of all links between the distinct fingerprints ``fp``."""
    bits = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    keys = []
    for t, (a, b) in enumerate(combinations(BLOCKS, 2)):
        keys.append(F.shiftleft(F.shiftleft(bits(*a), b[1] - b[0]).bitwiseOR(bits(*b)), 4).bitwiseOR(F.lit(t).cast("long")))
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread.join(crowded, "key")
    cuts = F.ceil(F.col("n") / SUB).cast("int")
    met = met.select("key", "fp", cuts.alias("cuts")).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    met = met.select("key", "fp", "sub", other.alias("other")).select("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "fp")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(_compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over the undirected edges (u, v); nodes without an edge are absent.

    Each round takes the smallest label of the neighbours (partially aggregated, so hubs don't skew it) and then
    jumps to the label's own label, until no label changes. Rounds are cut by checkpoints; only a count of changes reaches the driver.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct()
    both = checkpointed(both)
    state = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        seen = both.join(state, both.v == state.node).select(both.u.alias("node"), "root")
        low = seen.groupBy("node").agg(F.min("root").alias("m"))
        near = state.join(low, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        own = state.select(F.col("node").alias("r"), F.col("root").alias("above"))
        new = near.join(own, near.root == own.r, "left").select("node", "was", F.least("root", "above").alias("root"))
        new = checkpointed(new)
        changed = new.filter("root <> was").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, th, fp (signed long), component_id, first_th.

    component_id is the smallest doc_id reachable over links; first_th is the smallest text hash of that doc_id."""
    prints = checkpointed(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first")
    classes = checkpointed(prints.groupBy("fp").agg(first))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "first")
    return prints.join(named, "fp").select("doc_id", "th", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("first_th"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents with one row of each near-duplicate component: the smallest doc_id, ties by text hash."""
    kept = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th")))
    # one row for each component: rows without any id differ by fp
    kept = kept.groupBy("doc_id", "th").agg(F.first("fp").alias("one")).select(F.col("doc_id").alias("_kept"), F.col("th").alias("_kept_th"))
    src, names = by_place(docs)
    own, text = src[f"_c{names.index('doc_id')}"], f"_c{names.index('text')}"
    tagged = src.withColumn("_id", own.cast("long")).withColumn("_th", text_key(text))
    met = tagged.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_th") == F.col("_kept_th")), "left_semi")
    # of rows with one id and text the one of the smallest hash stays (maps can't be hashed and don't count)
    hashed = [c for c, kind in src.dtypes if "map<" not in kind and kind != "variant"]
    one = met.groupBy("_id", "_th").agg(F.min_by(F.struct(*src.columns), F.xxhash64(*hashed)).alias("_row"))
    return one.select("_row.*").toDF(*names)
