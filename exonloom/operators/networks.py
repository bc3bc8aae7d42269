"""Communication, networks, ambient correction, copy states and model application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ligand_receptor(states: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """(ligand, receptor, sender, receiver, score): states is (state, gene, mean, detection), pairs (ligand, receptor, weight).

    Each side is cut to states over the expression floor before sides meet on the pair.
    """
    total = F.sum("mean").over(Window.partitionBy("gene"))
    s = states.withColumn("spec", F.when(total > 0, F.col("mean") / total).otherwise(0.0)).filter(F.col("mean") > floor)
    side = lambda gene, state, p: s.select(F.col("gene").alias(gene), F.col("state").alias(state), *(F.col(c).alias(f"{p}_{c}") for c in ("mean", "detection", "spec")))
    e = pairs.join(side("ligand", "sender", "l"), "ligand").join(side("receptor", "receiver", "r"), "receptor")
    score = F.log1p("l_mean") * F.log1p("r_mean") * (F.lit(0.5) + F.least("l_detection", "r_detection") * 0.5) * (F.lit(0.5) + F.sqrt(F.col("l_spec") * F.col("r_spec")) * 0.5) * F.col("weight")
    return e.select("ligand", "receptor", "sender", "receiver", score.alias("score"))


def ambient_profile(matrix: DataFrame, share: float) -> DataFrame:
    """(gene, soup): what the ``share`` of cells with the smallest totals hold, normalised to 1."""
    totals = matrix.groupBy("cell").agg(F.sum("value").alias("total"))
    cut = totals.agg(F.percentile("total", F.lit(share)).alias("cut"))
    low = totals.crossJoin(F.broadcast(cut)).filter("total <= cut").select("cell")
    g = matrix.join(low, "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("s"))
    whole = g.agg(F.sum("s").alias("_whole"))
    return g.crossJoin(F.broadcast(whole)).select("gene", (F.col("s") / F.col("_whole")).alias("soup"))


def without_ambient(matrix: DataFrame, profile: DataFrame, rho: float) -> DataFrame:
    """(cell, gene, value): max(0, value - rho * soup * cell total), zeros dropped."""
    total = matrix.groupBy("cell").agg(F.sum("value").alias("_t"))
    left = matrix.join(total, "cell").join(profile, "gene", "left")
    return left.select("cell", "gene", (F.col("value") - F.col("_t") * F.coalesce("soup", F.lit(0.0)) * rho).alias("value")).filter("value > 0")


def edge_activity(edges: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """(source, target, by..., activity): weight * sqrt of the product of both ends' levels, negatives as 0."""
    a = levels.select(*by, F.col("gene").alias("source"), F.greatest("value", F.lit(0)).alias("_a"))
    b = levels.select(*by, F.col("gene").alias("target"), F.greatest("value", F.lit(0)).alias("_b"))
    return edges.join(a, "source").join(b, ["target", *by]).select("source", "target", *by, (F.col("weight") * F.sqrt(F.col("_a") * F.col("_b"))).alias("activity"))


def fold_matrix(levels: DataFrame, gene: str, group: str, value: str, control: str) -> DataFrame:
    """(gene, group, fold): value less the mean of the controls, shifted so that each gene's least is 0."""
    base = levels.filter(F.col("condition") == control).groupBy(gene).agg(F.avg(value).alias("_b"))
    d = levels.filter(F.col("condition") != control).join(base, gene).withColumn("_d", F.col(value) - F.col("_b"))
    return d.select(gene, group, (F.col("_d") - F.min("_d").over(Window.partitionBy(gene))).alias("fold"))


def copy_state(values: DataFrame, key: list[str], value: str, ratios: list[float], sd: float) -> DataFrame:
    """(key..., copies, lead): the ratio of largest Gaussian likelihood, the smaller at a tie, and twice its lead over 1.

    A value in the middle of two ratios ties; likelihoods are compared to six places, so that the last bits of a mean,
    which depend on the order of its rows, don't decide."""
    ll = lambda r: -((F.col(value) - F.lit(r)) * (F.col(value) - F.lit(r))) / (2 * sd * sd)
    best = F.array_max(F.array(*(F.struct(F.round(ll(r), 6).alias("near"), F.lit(-r).alias("neg"), ll(r).alias("ll")) for r in ratios)))
    return values.select(*key, (-best["neg"]).alias("copies"), ((best["ll"] - ll(1.0)) * 2).alias("lead"))


def applied_weights(levels: DataFrame, weights: DataFrame, intercepts: DataFrame, sample: str) -> DataFrame:
    """(sample, target, value): sum of weight * level over the genes that are there, plus the intercept, within 0..1."""
    s = levels.join(weights, "gene").groupBy(sample, "target").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"))
    return s.join(intercepts, "target").select(sample, "target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") + F.col("intercept"))).alias("value"))


def network_extract(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with both ends in ``genes`` (gene) and no loops."""
    a, b = genes.select(F.col("gene").alias("source")).distinct(), genes.select(F.col("gene").alias("target")).distinct()
    return edges.filter("source != target").join(a, "source", "left_semi").join(b, "target", "left_semi")
