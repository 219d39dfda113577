"""Canary search: which texts hold which strings of a table, by an Aho-Corasick automaton in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of the strings that make one automaton; larger tables are cut into several, each a pass over the texts.
LIMIT = 4 << 20


def canary_hits(texts: DataFrame, canaries: DataFrame, key: str, text: str, canary_key: str, canary: str, limit: int = LIMIT) -> DataFrame:
    """(key, canary_key): every pair of a text and a canary that stands in it, once; null and empty canaries and null texts match nothing.

    The canaries' size is summed before any is sent: a block of them is at most ``limit`` bytes (or one string), travels to the tasks as a list, and
    becomes an automaton there, so that a text is read once a block whatever the number of canaries."""
    spark = texts.sparkSession
    own = canaries.filter(f"`{canary}` <> ''").select(F.col(canary_key).alias("_c"), F.col(canary).cast("string").alias("_s"))
    strings = own.select("_s").distinct()
    size = strings.agg(F.sum(F.octet_length("_s")).alias("n")).first().n or 0
    blocks = max(1, -(-2 * size // limit))  # hashed blocks differ in size: half full on the average
    src = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    found = None
    for number in range(blocks):
        block = strings.filter(F.pmod(F.xxhash64("_s"), F.lit(blocks)) == number) if blocks > 1 else strings
        wanted = spark.sparkContext.broadcast([r[0] for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for s in wanted.value:
                machine.add_word(s, s)
            if wanted.value:
                machine.make_automaton()
            for b in batches:
                at, hits = [], []
                for i, t in enumerate(b.column(1).to_pylist() if wanted.value else ()):
                    for s in {s for _, s in machine.iter(t)}:
                        at.append(i)
                        hits.append(s)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], ["_k", "_s"])

        part = src.mapInArrow(run, f"_k {kind}, _s string")
        found = part if found is None else found.unionAll(part)
    return found.join(own, "_s").select(F.col("_k").alias(key), F.col("_c").alias(canary_key)).distinct()
