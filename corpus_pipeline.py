"""From raw documents to training tokens: quality, toxicity, near-dedup, mixing and BPE, each over all that is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``.  The mix's training order is that of the files and rows that its
stage writes; the last stage turns it into a column, ``position``.

Defined results of odd rows: ids may be null or repeat and each row is judged by its own text; a null or empty text is
judged as a text without words by the classifiers, is linked with nothing, and is never taken by the mix; a null source
is a source of its own; further columns of ``documents`` go through to the mix's output.  An empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.llm import bpe, mixing, quality, toxicity
from exonloom.llm.common import collected, cut, discard, merged
from exonloom.llm.minhash_dedup import near_duplicates
from exonloom.llm.queries import vocabulary_file


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose probability of label 1 is 0.7 or more; without labels of both kinds, all."""
    model = quality.fitted(docs, _labels(spark, sf_dir), where=quality.training_rows(4, 2))
    return quality.scored(docs, model, keep=True)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of severity grade 0; without labels of both kinds, all."""
    return toxicity.severity(docs, toxicity.fitted(docs, _labels(spark, sf_dir)), keep=True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``_row``, a number of its own for each row that rereading doesn't change.

    Its lower bits are the row's place in the files that Spark wrote, or else in a copy; its upper ones grow with
    doc_id, null coming last.  So near-dedup, which compares a bucket's members with the least first, starts from the
    text that came first, of which the others are most likely copies.
    """
    parts = [re.fullmatch(r".*/part-(\d+)-[^/]*", f) for f in docs.inputFiles()]
    written = parts and all(parts) and len({p[1] for p in parts}) == len(parts)
    placed = docs.withColumn("_place", written_order(docs)) if written else cut(docs.withColumn("_place", F.monotonically_increasing_id()))
    most, low, high = placed.agg(F.max("_place"), F.min("doc_id"), F.max("doc_id")).first()
    bits = (most or 0).bit_length()
    steps = float((1 << (62 - bits)) - 1)
    share = (F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(max(float(high or 0) - float(low or 0), 1.0))
    coarse = F.coalesce(F.floor(share * steps), F.lit(int(steps))).cast("bigint")
    return placed.withColumn("_row", F.shiftleft(coarse, bits).bitwiseOR(F.col("_place"))).drop("_place")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or over others, the one with the smallest id.

    It is decided by row, as ids may be null, which come last, or repeat: at equal ids the text with the smallest hash
    stays, of equal texts one row.  Different texts of an id stay, and so do rows without words.
    """
    own = numbered(docs)
    found = near_duplicates(own, id_col="_row", width=5, percent=80, m=7).select("_row", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("print"), "_row")
    first = own.select("_row", place.alias("place")).join(merged(found), "_row").groupBy("component_id").agg(F.min("place").alias("place"))
    return own.join(merged(first.select("place._row")), "_row", "left_semi").drop("_row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in training order; one that a pass takes in part is there as a whole."""
    return mixing.training_order(mixing.mix_sources(docs, carry=True))


def written_order(docs: DataFrame) -> Column:
    """A number that ascends over the rows as they were written: the file's place, then the row's in its file; null
    for a table that isn't read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.lit(None).cast("bigint")
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint")
    return F.shiftleft(file, 36) + F.col("_metadata.row_index")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with their hash, that of the text they decode to, and its position in training."""
    return bpe.encoded(docs, vocabulary_file(), carry=[written_order(docs).alias("position")])


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: SQL can express neither the fitted models nor the tokens; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir))
        discard(docs)
        collected(after)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
