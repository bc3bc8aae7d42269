"""Logical tables of the engine, cut from the supplied relational tables.

Each function returns a DataFrame with the columns of a logical schema; each constant of the same name in capitals is
the DuckDB subquery with the same rows, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(sample, feature, gene, count, ord): one row per observed count; ord is a total order of the input."""
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("sample"),
        F.col("l_partkey").alias("feature"),
        F.col("l_suppkey").alias("gene"),
        F.col("l_quantity").cast("bigint").alias("count"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_linestatus").alias("strand"),
    )


COUNTS = "(SELECT l_returnflag || l_linestatus AS sample, l_partkey AS feature, l_suppkey AS gene, CAST(l_quantity AS BIGINT) AS count, l_orderkey * 10 + l_linenumber AS ord, l_linestatus AS strand FROM lineitem)"


def obs(spark: SparkSession, d: str) -> DataFrame:
    """(cell, state, donor, condition): one row per cell."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("state"), F.col("c_nationkey").alias("donor"), F.when(F.col("c_acctbal") >= 5000, "case").otherwise("control").alias("condition"))


OBS = "(SELECT c_custkey AS cell, c_mktsegment AS state, c_nationkey AS donor, CASE WHEN c_acctbal >= 5000 THEN 'case' ELSE 'control' END AS condition FROM customer)"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(cell, gene, value): nonzero expression, long."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").cast("bigint").alias("value"))


MATRIX = "(SELECT o_custkey AS cell, l_suppkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def junctions(spark: SparkSession, d: str) -> DataFrame:
    """(gene, start, end, sample, count): a junction's count in a sample."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") + 1).alias("end"), F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_quantity").cast("bigint").alias("count"))


JUNCTIONS = "(SELECT l_suppkey AS gene, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) + 1 AS \"end\", l_returnflag || l_linestatus AS sample, CAST(l_quantity AS BIGINT) AS count FROM lineitem)"


def positions(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, gene, value): ordered measurements along a chromosome."""
    return table(spark, d, "events").select(F.col("event_type").alias("chrom"), F.col("event_id").alias("pos"), F.col("user_id").alias("gene"), "value")


POSITIONS = "(SELECT event_type AS chrom, event_id AS pos, user_id AS gene, value FROM events)"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, start, end, id, ord): spans of orders; chrom is the priority class."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("chrom"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 20 + F.pmod(F.col("o_custkey"), F.lit(60))).alias("end"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ord"))


INTERVALS = "(SELECT o_orderpriority AS chrom, o_orderkey * 10 AS start, o_orderkey * 10 + 20 + o_custkey % 60 AS \"end\", o_orderkey AS id, o_custkey AS ord FROM orders)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc, lang, source, tokens): structures as arrays of tokens."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "source", F.split("text", " ").alias("tokens"))


TOKENS = "(SELECT doc_id AS doc, lang, source, string_split(text, ' ') AS tokens FROM documents)"
