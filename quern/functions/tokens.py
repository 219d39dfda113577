"""BPE token counts, ids and texts from a vocabulary file (a tiktoken rank file; its path is a parameter)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StructType

#: Fixed value: the pattern that splits texts into pieces before byte pairs merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str = RANKS):
    """One encoder a worker process; executors need the file at ``path``, or its name as added by sparkContext.addFile."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, path: str = RANKS) -> Column:
    """BPE tokens of a text; null counts as empty."""

    @pandas_udf("int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in texts:
            yield s.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    return run(F.col(text) if isinstance(text, str) else text)


def encode(text: str | Column, path: str = RANKS) -> Column:
    """array<int> of ids; null gives none."""

    @pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in texts:
            yield s.map(lambda t: e.encode_ordinary(t) if t else [])

    return run(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str = RANKS) -> Column:
    """Text of ids; bytes that are no UTF-8 (ids cut inside a character) become the replacement character."""

    @pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in columns:
            yield s.map(lambda x: e.decode(list(x)) if x is not None else None)

    return run(F.col(ids) if isinstance(ids, str) else ids)


#: Most chunks of an output batch, and its characters before it ends.
BATCH_CHUNKS, BATCH_CHARS = 1024, 1 << 20


def cut_texts(keys: pa.Array, texts: pa.Array, size: int, overlap: int, path: str = RANKS) -> Iterator[tuple[pa.Array, list[int], list[int], list[str]]]:
    """(keys, places, tokens, contents) of the windows of some texts, a bounded number at a time; null texts count as empty and give none."""
    e = encoding(path)
    rows, at, n, content, held = [], [], [], [], 0
    for i, text in enumerate(texts):
        ids = e.encode_ordinary(text.as_py() or "")
        for k, lo in enumerate(range(0, len(ids), size - overlap)):
            part = ids[lo : lo + size]
            rows.append(i)
            at.append(k)
            n.append(len(part))
            content.append(e.decode(part))
            held += len(content[-1])
            if len(rows) >= BATCH_CHUNKS or held >= BATCH_CHARS:
                yield keys.take(pa.array(rows, pa.int64())), at, n, content
                rows, at, n, content, held = [], [], [], [], 0
    if rows:
        yield keys.take(pa.array(rows, pa.int64())), at, n, content


def bpe_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 100, path: str = RANKS) -> DataFrame:
    """(key, chunk_order_index, tokens, content, chunk_id): windows of ``size`` tokens, ``overlap`` of them shared with the next. A task encodes, cuts and decodes
    one text at a time and holds the ids of no other."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be 0 or more and less than size")
    src = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, at, n, content in cut_texts(b.column(0), b.column(1), size, overlap, path):
                yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(content, pa.string())], names)

    shape = StructType([src.schema[0], *StructType.fromDDL("chunk_order_index int, tokens int, _content string")])
    names = shape.names
    out = src.mapInArrow(run, shape).select(key, "chunk_order_index", "tokens", F.trim("_content").alias("content"))
    return out.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content")))
