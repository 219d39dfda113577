"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the UTF-8 bytes; a chunk ends before a white-space byte where two bits of the hash of
the last 16 bytes are zero, or where five bits are before any character if the last ``MIN_CHUNK`` bytes hold no white space,
at ``MIN_CHUNK`` bytes or later and at ``MAX_CHUNK`` at the latest. Boundaries depend on
nearby bytes only, so inserted text shifts no boundary beyond it. A chunk is identified by its 64-bit XXH3 digest; the
first holder of a digest is the smallest doc_id (in one document: the first place). Neighbouring repeated chunks
form a run, whatever their first holders, and runs of ``MIN_RUN`` bytes or more are repeated substrings: each of their chunks is
removed from every document but its first holder. Runs shorter than that are common phrases and stay.

Scale: first holders are a partially aggregated min; the join that brings them back to the documents splits hot
digests (both sides are plain shuffles, so AQE's skew join applies); each document's runs are a list bounded by
its own text.

Edge cases: null texts stay null, empty ones empty, with no spans; rows with one doc_id count as one document
(identical rows get identical results, none is removed as the other's copy); rows with a null doc_id only lose
repeats of their own text or of documents with an id and are never first holders; runs belong to a row by its doc_id and the whole
64-bit hash of its text, so rows of one doc_id, or without any, keep apart; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, checkpointed, text_key, text_slices, utf8, widened

MIN_CHUNK = 24
MAX_CHUNK = 512
#: Bytes that neighbouring repeated chunks must cover together.
MIN_RUN = 100
_MASK = np.uint16(0x6000)
#: The mask bits where no white space is near.
_DENSE = np.uint16(0x7C00)
#: One 16-bit value for each byte, by rule: the XXH64 of the byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions where a chunk may end: the gear hash of the 16 bytes before has zero mask bits and white space follows, or,
    after MIN_CHUNK bytes without white space, more zero bits and a character begins."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint16(step)
        h = nxt
    hit = (h[:-1] & _MASK) == 0
    space = _SPACE[data]
    far = np.flatnonzero((h[:-1] & _DENSE) == 0) + 1
    far = far[(far >= MIN_CHUNK) & (data[far] & 0xC0 != 0x80)]
    if len(far):
        gaps = np.append(-1, np.flatnonzero(space))  # the last white space before each place
        far = far[far - gaps[np.searchsorted(gaps, far) - 1] > MIN_CHUNK]
    hit &= space[1:]
    hit[far - 1] = True
    return np.flatnonzero(hit) + 1


def cuts(data: np.ndarray, found: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end], given the candidate positions inside."""
    out, last = [], start
    for c in [*found, end]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if c - last >= MIN_CHUNK or c == end and c > last:
            out.append(c)
            last = c
    return out


def _chunks(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id) of each document's distinct chunks or, with places, all chunks as (digest, doc_id, th, at, local):
    th is the text hash, at packs the byte offset and the length; local marks repeats within the text."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        ids, hashes = b.column("doc_id"), b.column("th")
        col = b.column("text")
        raw, off = utf8(col)
        for lo, hi in text_slices(col):
            base = int(off[lo])
            data = raw[base : off[hi]]
            if len(data) == 0:
                continue
            whole = data.tobytes()
            found = candidates(data)
            ends = off[lo : hi + 1] - base
            split = np.searchsorted(found, ends, side="right")
            hs: list[int] = []
            rows: list[int] = []
            at: list[int] = []
            local: list[bool] = []
            for k in range(hi - lo):
                s, e = int(ends[k]), int(ends[k + 1])
                if s == e:
                    continue
                seen: set[int] = set()
                last = s
                for c in cuts(data, [x for x in found[split[k] : split[k + 1]].tolist() if x < e], s, e):
                    h = digest(whole[last:c])
                    again = h in seen
                    if places or not again:
                        hs.append(h)
                        rows.append(lo + k)
                        if places:
                            at.append((last - s) << 16 | (c - last))
                            local.append(again)
                    seen.add(h)
                    last = c
            of = pa.array(rows, pa.int64())
            cols = [pa.array(np.array(hs, np.uint64).view(np.int64)), ids.take(of)]
            names = ["digest", "doc_id"]
            if places:
                cols += [hashes.take(of), pa.array(at, pa.int64()), pa.array(local, pa.bool_())]
                names += ["th", "at", "local"]
            yield pa.RecordBatch.from_arrays(cols, names)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))


def first_holders(docs: DataFrame) -> DataFrame:
    """(digest, first): chunks that two or more documents, or one and a row without a doc_id, hold, with the smallest doc_id."""
    rows = _source(docs).mapInArrow(lambda it: _chunks(it, False), "digest long, doc_id long")
    held = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("stray"))
    return held.filter("first < last or first is not null and stray").select("digest", "first")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, runs): for each text with repeats, its repeated chunks [(offset, length, first holder)]."""
    holders = checkpointed(first_holders(docs))
    places = _source(docs).mapInArrow(lambda it: _chunks(it, True), "digest long, doc_id long, th long, at long, local boolean")
    met = places.join(holders, "digest", "left").filter(F.col("local") | (F.col("first") < F.coalesce("doc_id", F.lit(2**63 - 1))))
    other = F.when(F.col("first") < F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("first")).otherwise(F.col("doc_id"))
    chunk = F.struct(
        F.shiftright("at", 16).cast("int").alias("start"),
        F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("length"),
        other.alias("first"),
    )
    # a set: rows that share id and text, or lack an id, bring each chunk once, so a row's list is bounded by its own text
    return met.groupBy("doc_id", "th").agg(F.collect_set(chunk).alias("runs"))


def merge_runs(chunks: list[tuple[int, int, int | None]]) -> list[tuple[int, int, list]]:
    """Sorted (start, length, first) chunks to (start, end, holders) runs of MIN_RUN bytes or more.

    Neighbours join a run whatever their first holders, which are listed in order of place, each once."""
    out: list[list] = []
    for start, length, first in sorted(set(chunks), key=lambda c: (c[0], c[1], c[2] is None, c[2] or 0)):
        if out and out[-1][1] == start:
            out[-1][1] = start + length
            if first not in out[-1][2]:
                out[-1][2].append(first)
        else:
            out.append([start, start + length, [first]])
    return [(a, b, f) for a, b, f in out if b - a >= MIN_RUN]


def deduplicated(docs: DataFrame, removed: str = "removed_bytes", spans_as: str = "spans") -> DataFrame:
    """Every row of docs with its text without repeated runs, and the columns removed_bytes (int), spans
    (array of start, end, first, holders in bytes of the original text, holders = the doc_ids that keep parts of the passage, first = the
smallest of them), under the given names; they
    replace columns of docs with these names."""
    src, names = by_place(docs)
    inner = src.columns
    key, at = names.index("doc_id"), names.index("text")
    runs = repeated_runs(docs).toDF("_id", "_th", "_runs")
    src = src.withColumn(inner[at], F.col(inner[at]).cast("string"))
    met = src.join(runs, src[inner[key]].cast("long").eqNullSafe(F.col("_id")) & (text_key(inner[at]) == F.col("_th")), "left").select(*inner, "_runs")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, cut, spans = [], [], []
            for t, r in zip(b.column(at).to_pylist(), b.column("_runs").to_pylist()):
                found = merge_runs([(x["start"], x["length"], x["first"]) for x in r]) if r and t else []
                if found:
                    raw, out, last = t.encode(), [], 0
                    for a, z, _ in found:
                        out.append(raw[last:a])
                        last = z
                    out.append(raw[last:])
                    t = b"".join(out).decode()
                text.append(t)
                cut.append(sum(z - a for a, z, _ in found))
                spans.append([{"start": a, "end": z, "first": min((x for x in f if x is not None), default=None), "holders": f} for a, z, f in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64()), ("holders", pa.list_(pa.int64()))]))
            cols = [*b.columns[: len(inner)], pa.array(cut, pa.int32()), pa.array(spans, kind)]
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*inner, "_cut", "_spans"])

    done = met.mapInArrow(strip, widened(src.schema, "_cut int, _spans array<struct<start:int,end:int,first:bigint,holders:array<bigint>>>"))
    kept = [F.col(i).alias(n) for i, n in zip(inner, names) if n not in (removed, spans_as)]
    return done.select(*kept, F.col("_cut").alias(removed), F.col("_spans").alias(spans_as))
