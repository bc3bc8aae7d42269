"""One query opN_<name> per operator, over whole tables with production parameters, and the SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.llm import bpe, cross_polytope, html_text, itq, licenses, mixing, ppm, quality, toxicity
from exonloom.llm.common import crc_remainder, cut
from exonloom.llm.minhash_dedup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    position = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(-1)).alias("position")  # -1: not taken
    out = cut(mixed.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", position))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fitted(docs, _table(spark, sf_dir, "labels")))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fitted(docs, _table(spark, sf_dir, "labels"), where=quality.training_rows(4, 2))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return quality.scored(docs, model).select("doc_id", held_out, "score", "predicted")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(_table(spark, sf_dir, "embeddings"))


def op8_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; the package that holds it is installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), vocabulary_file(), with_ids=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scanned(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_html_text": op2_html_text,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_ppm": op5_ppm,
    "op6_quality": op6_quality,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_itq_dedup": op8_itq_dedup,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
}
