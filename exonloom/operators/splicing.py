"""Percent spliced in and what goes with it.

Two junctions of a gene compete if their spans overlap by more than an end point; a junction's clique is all that it
competes with, itself included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.operators.joins import overlap_join

#: Least bin width of the clique join.
WIDTH = 64


def bin_width(spans: DataFrame) -> int:
    """Twice the length that nine in ten spans have at most: a span then falls into few bins, and so do long ones."""
    row = spans.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.9)).first()
    return max(WIDTH, 2 * int(row[0] or 0))


def cliques(junctions: DataFrame) -> DataFrame:
    """(gene, start, end, other_start, other_end) over distinct junctions."""
    own = junctions.select("gene", "start", "end").distinct()
    width = bin_width(own)
    a = own.select("gene", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = own.select("gene", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = overlap_join(a, b, ["gene"], width)
    return both.select("gene", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_start").alias("other_start"), F.col("b_end").alias("other_end"))


def psi(junctions: DataFrame, least: int) -> DataFrame:
    """(gene, start, end, sample, inclusion, clique, psi) for every sample in which the clique has a count; psi is null
    if the clique's count is below ``least``."""
    key = ["gene", "start", "end"]
    counts = junctions.groupBy(*key, "sample").agg(F.sum("count").alias("count"))
    other = counts.select("gene", F.col("start").alias("other_start"), F.col("end").alias("other_end"), "sample", "count")
    seen = cliques(junctions).join(other, ["gene", "other_start", "other_end"])
    mine = (F.col("start") == F.col("other_start")) & (F.col("end") == F.col("other_end"))
    out = seen.groupBy(*key, "sample").agg(F.sum(F.when(mine, F.col("count")).otherwise(0)).alias("inclusion"), F.sum("count").alias("clique"))
    return out.withColumn("psi", F.when(F.col("clique") >= least, F.col("inclusion") / F.col("clique")))


def background(junctions: DataFrame) -> DataFrame:
    """(gene, start, end, background_start, background_end): the competing junction of the largest total, the first by
    place at a tie."""
    total = junctions.groupBy("gene", F.col("start").alias("other_start"), F.col("end").alias("other_end")).agg(F.sum("count").alias("total"))
    pairs = cliques(junctions).filter("start != other_start or end != other_end").join(total, ["gene", "other_start", "other_end"])
    best = pairs.groupBy("gene", "start", "end").agg(F.min(F.struct((-F.col("total")).alias("t"), "other_start", "other_end")).alias("x"))
    return best.select("gene", "start", "end", F.col("x.other_start").alias("background_start"), F.col("x.other_end").alias("background_end"))


def informative(ratios: DataFrame, least: int, spread: float) -> DataFrame:
    """Junctions with two samples of ``least`` inclusion counts, two of ``least`` clique counts, and a range of psi of
    ``spread`` or more: (gene, start, end, range)."""
    spread_of = F.max("psi") - F.min("psi")
    g = ratios.groupBy("gene", "start", "end").agg(spread_of.alias("range"), F.count_if(F.col("inclusion") >= least).alias("_i"), F.count_if(F.col("clique") >= least).alias("_c"))
    return g.filter((F.col("_i") > 1) & (F.col("_c") >= 2) & (F.col("range") >= spread)).drop("_i", "_c")
