"""SentencePiece encoding and decoding with a streaming Viterbi.

The lattice has a node at each character boundary and an arc for each piece. For a BPE model the best path is the one
on which every two neighbouring pieces are what the merge rule itself makes of their joint text; exactly one arc
into each node continues a valid path, so the Viterbi keeps one backpointer a node. Only the last ``longest piece``
nodes can still be followed by later arcs: the window. When the backpointer paths of all nodes of the window meet
in one boundary, the ids before it are final and are committed.

In models whose pieces hold the space mark only in front, no arc crosses the place before a run of spaces or beside a
line break, so all paths converge there whatever the window holds. A text is therefore read as a sequence of segments between
such places. Segments up to two windows long go through a bounded memo: the new ones of a slice are taken once each, in sorted
order, so that the nodes of a common prefix are computed once; longer segments stream through the window.
``Model.stream`` runs the window over any text, memo or not, and gives the same ids. Ids equal the library's for the
model, including byte fallback for unknown characters.

Edge cases: null counts as empty and empty texts give no ids; repeated rows get equal results; texts of any length
use a window of fixed size; a space mark in the text is encoded as the space that the format takes it for, and round_trip is false;
other columns are kept; an empty table gives an empty result. Executors need the model file at ``path``, or its name as
added by ``spark.sparkContext.addFile``.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, text_slices, texts, widened

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments in each of the two generations of the memo.
MEMO_SIZE = 200_000
#: What an id of no piece stands for: a character outside the vocabulary, or the start of a segment.
UNKNOWN, START = -1, -2
_ONE = (1,)


class Model:
    """A BPE piece model read from its file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with the identity normalizer is needed")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if any(MARK in p[1:] and set(p) != {MARK} or "\n" in p for p, _, kind in pieces if kind == 1):
            raise ValueError("pieces must hold the space mark in front only")
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.score = [s for _, s, _ in pieces]
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.raw = [bytes([int(p[1:-1], 16)]) if kind == 6 else p.replace(MARK, " ").encode() if kind == 1 else b"" for p, _, kind in pieces]
        self.longest = max(map(len, self.ids))
        self.pad = "\n" * self.longest
        #: (id << 20 | id) to whether the two pieces may stand side by side
        self.fits: dict[int, bool] = {}
        self.text = [p for p, _, _ in pieces]
        # pieces that the merges can't build never occur
        self.made = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.lengths = [len(p) for p, _, _ in pieces] + [1]  # the last one serves UNKNOWN
        # lengths of the pieces with the same last characters, longest first
        ends: dict[str, set[int]] = {}
        for p in self.made:
            if len(p) > 2:
                ends.setdefault(p[-3:], {1}).add(len(p))
        for p, lengths in ends.items():
            if p[1:] in self.made:
                lengths.add(2)
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.pairs = {p: (2, 1) for p in self.made if len(p) == 2}
        # word to ids, in front of which one space stands, and other segments; a young and an old generation of each
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def merge(self, s: str) -> list[str]:
        """Merge by the rule: the best-scored, then leftmost, neighbouring pair whose joint text is a piece."""
        parts, ids, score = list(s), self.ids, self.score
        worth = [score[i] if (i := ids.get(a + b)) is not None else None for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, w in enumerate(worth):
                if w is not None and (best is None or w > best):
                    best, at = w, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            for k in (at - 1, at):  # only the pairs beside the merged one change
                if 0 <= k < len(worth):
                    i = ids.get(parts[k] + parts[k + 1])
                    worth[k] = score[i] if i is not None else None

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges of two pieces' joint text give both back."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        x, y = self.text[a], self.text[b]
        ok = self.fits[a << 20 | b] = self.merge(x + y) == [x, y]
        return ok

    def extend(self, padded: str, last: list[int], begin: int, end: int) -> None:
        """Append the backpointers of the nodes begin + 1 to end: the id of the piece that ends there.

        padded is the segment after the line breaks of ``pad``, which no piece holds; last holds the nodes up to begin, the
        first of them START, and may begin later than the segment."""
        ends, pairs, made, fits, fit, push = self.ends, self.pairs, self.made.get, self.fits.get, self.fit, last.append
        front = self.longest
        for i in range(front + begin + 1, front + end + 1):  # i: where the text of the node ends in padded
            lengths = ends.get(padded[i - 3 : i])
            if lengths is None:
                lengths = pairs.get(padded[i - 2 : i], _ONE)
            for length in lengths:
                if length == 1:
                    own = made(padded[i - 1], UNKNOWN)
                else:
                    own = made(padded[i - length : i])
                    if own is None:
                        continue
                before = last[-length]
                if before < 0 or own < 0:
                    break
                ok = fits(before << 20 | own)
                if ok is None:
                    ok = fit(before, own)
                if ok:
                    break
            else:
                raise AssertionError("no path")
            push(own)

    def back(self, last: list[int], end: int, chars: str) -> list[int]:
        """Ids of the path that ends in node ``end`` of last; chars: the text of its nodes, for byte fallback."""
        out, lengths = [], self.lengths
        while end > 0:
            own = last[end]
            if own >= 0:
                out.append(own)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chars[end - 1].encode("utf-8", "replace")[::-1])
            else:
                out.append(self.unknown)
            end -= lengths[own]
        return out[::-1]

    def stream(self, s: str) -> Iterator[list[int]]:
        """Committed ids of s (spaces as marks), in order. The window holds the nodes since the last commit; at every
        ``longest`` nodes the paths of those that later arcs can follow are traced, and what lies before the node
        where they meet is committed."""
        padded, n, lengths = self.pad + s, len(s), self.lengths
        done, at, last = 0, 0, [START]
        while at < n:
            ahead = min(n, at + self.longest)
            self.extend(padded, last, at, ahead)
            at = ahead
            nodes = set(range(max(0, len(last) - self.longest), len(last)))
            while len(nodes) > 1:  # follow the furthest path back until all meet
                top = max(nodes)
                nodes.remove(top)
                nodes.add(top - lengths[last[top]])
            meet = nodes.pop()
            if meet and at < n and (cut := meet - lengths[last[meet]]):
                # the piece before the meeting point stays: it is what the next arcs must fit
                yield self.back(last, cut, s[done : done + cut])
                last = last[cut:]
                last[0] = START
                done += cut
        yield self.back(last, len(last) - 1, s[done:])

    def encode_segments(self, parts: list[str]) -> dict[str, bytes]:
        """int32 ids of distinct segments."""
        out, last, before = {}, [START], ""
        for part in sorted(parts):
            s = part.replace(" ", MARK)
            if len(s) > 2 * self.longest:
                out[part] = array("i", [i for ids in self.stream(s) for i in ids]).tobytes()
                continue
            common = 0
            for x, y in zip(before, s):
                if x != y:
                    break
                common += 1
            del last[common + 1 :]
            self.extend(self.pad + s, last, common, len(s))
            before = s
            out[part] = array("i", self.back(last, len(s), s)).tobytes()
        return out

    def _remember(self, memo: dict[str, bytes], old: dict[str, bytes], need: set[str], front: str) -> None:
        """Bring the ids of all needed segments (front + key) into the memo."""
        new = []
        for k in need.difference(memo):
            got = old.get(k)
            if got is None:
                new.append(front + k)
            else:
                memo[k] = got
        skip = len(front)
        for k, ids in self.encode_segments(new).items():
            memo[k[skip:]] = ids

    def encode_all(self, ts: list[str]) -> list[bytes]:
        """int32 ids of whole texts, as the library gives them."""
        if len(self.spaced) + len(self.plain) > MEMO_SIZE:
            self.old, self.spaced, self.plain = (self.spaced, self.plain), {}, {}
        lines: list[list[tuple[str, list[str]]]] = []  # of each text's lines the segment in front and the words after one space each
        spaced: set[str] = set()
        plain: set[str] = {"\n"}
        for t in ts:
            own = []
            if t:
                t = t.replace(MARK, " ")
                for line in (" " + t if self.prefix else t).split("\n"):
                    front, *words = line.split(" ")
                    if "" in words:  # runs of spaces belong to the word after them
                        words, gap, several = [], "", line[len(front) :].split(" ")[1:]
                        for w in several:
                            if w:
                                words.append(gap + w)
                                gap = ""
                            else:
                                gap += " "
                        if gap:  # at the end of the line
                            words.append(gap[1:])
                    spaced.update(words)
                    plain.add(front)
                    own.append((front, words))
            lines.append(own)
        self._remember(self.spaced, self.old[0], spaced, " ")
        self._remember(self.plain, self.old[1], plain, "")
        get, plain_get, new_line = self.spaced.__getitem__, self.plain.__getitem__, self.plain["\n"]
        out = [new_line.join([plain_get(front) + b"".join(map(get, words)) for front, words in own]) for own in lines]
        longest = 2 * self.longest
        for memo, need in ((self.spaced, spaced), (self.plain, plain)):
            for k in need:
                if len(k) >= longest:
                    memo.pop(k)
        return out

    def encode(self, text: str) -> bytes:
        """int32 ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, marks as spaces, without the space that encoding put in front."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str = MODEL) -> Model:
    """One model a worker process."""
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return Model(path)


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with the columns piece_ids array<int>, n_pieces int and round_trip boolean (decoding the ids gives the text back).
    They replace columns of docs with these names."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    at = names.index("text")
    src = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for lo, hi in text_slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                ts = texts(part.column(at))
                done = m.encode_all(ts)
                counts = np.array([len(x) // 4 for x in done], np.int32)
                flat = np.frombuffer(b"".join(done), np.int32)
                ends = np.cumsum(counts)
                same = [m.decode(flat[z - n : z]) == t for t, n, z in zip(ts, counts.tolist(), ends.tolist())]
                cols = [*part.columns, list_array(flat, counts, pa.int32()), pa.array(counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, [*inner, "_ids", "_n", "_same"])

    out = src.mapInArrow(run, widened(src.schema, "_ids array<int>, _n int, _same boolean"))
    added = ("piece_ids", "n_pieces", "round_trip")
    return out.select(*[F.col(i).alias(n) for i, n in zip(inner, names) if n not in added], F.col("_ids").alias("piece_ids"), F.col("_n").alias("n_pieces"), F.col("_same").alias("round_trip"))


def decoded(df: DataFrame, ids: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """df with the column decoded: the text of the ids (null ids: empty)."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(col):
        m = model(path)
        return col.map(lambda x: m.decode(np.asarray(x, np.int32)) if x is not None else "")

    return df.withColumn("decoded", run(F.col(ids)))
