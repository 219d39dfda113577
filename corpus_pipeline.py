"""Corpus cleaning as a chain of stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, pieces, simhash, substrings, toxicity
from quern.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.reject(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate component stays."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the text; n_chars follows."""
    names = docs.columns
    removed, spans = "_" * max(map(len, names)) + "removed", "_" * max(map(len, names)) + "spans"  # no column of docs
    out = substrings.deduplicated(docs, removed, spans)
    if "n_chars" in names:
        shorter = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", shorter)
    return out.drop(removed, spans)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept text as piece ids."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Learned models and fingerprints have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; every stage's result is cut in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
