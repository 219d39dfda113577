"""The registered opN_ queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lm, media, mixing, negatives, pages, pieces, quality, simhash, substrings, toxicity, whitening
from .common import held_out, table


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    sources = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["holders"]))))
    other = F.exists(sources, lambda d: ~d.eqNullSafe(F.col("doc_id")))  # repeated: a passage of an earlier document; inside: of the text's own only
    return found.select("doc_id", other.alias("repeated"), ((F.col("removed_bytes") > 0) & ~other).alias("repeated_inside"), "removed_bytes", sources.alias("first_doc_ids"), "spans", "text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents")).drop("th")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.CONTRACT).drop("matches")


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.base_phrases(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("th")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents")).select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    clip = F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"], c["last_frame"], c["start_ms"], c["end_ms"], c["level"].cast("string")))
    return read.withColumn("feature", F.concat_ws(";", clip)).drop("clips")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("source")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=1).select("vec_id", "n", "deviation")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", negatives.relabelled())
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_simhash, op4_license_scan, license_base_phrases, op5_decontamination, op6_toxicity, op7_html_text, op8_pieces, op9_quality, op10_media, op11_source_mix, op12_whitening, whitening_deviations, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"license_base_phrases": licenses.BASE_SQL, "op11_source_mix": mixing.TAKEN_SQL, "whitening_deviations": whitening.DEVIATION_SQL, "op13_hard_negatives": negatives.NEGATIVES_SQL}
