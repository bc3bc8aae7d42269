"""Tumour specificity, genotype association, marker blocks, copy-number arms, cross-dataset events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def specific_by_mean(tumour: DataFrame, normal: DataFrame, n_tumour: int, n_normal: int, most_normal: float, least_gain: float) -> DataFrame:
    """(feature, mean_tumour, mean_normal): normal mean under ``most_normal``, tumour mean ``least_gain`` above it."""
    t = tumour.groupBy("feature").agg((F.sum("count") / n_tumour).alias("mean_tumour"))
    n = normal.groupBy("feature").agg((F.sum("count") / n_normal).alias("mean_normal"))
    both = t.join(n, "feature", "left").withColumn("mean_normal", F.coalesce("mean_normal", F.lit(0.0)))
    return both.filter((F.col("mean_normal") < most_normal) & (F.col("mean_tumour") - F.col("mean_normal") > least_gain))


def specific_by_prevalence(tumour: DataFrame, normal: DataFrame, n_tumour: int, n_normal: int, least: float, most: float) -> DataFrame:
    """(feature, tumour, normal): share of samples with the feature, over ``least`` and under ``most``."""
    share = lambda df, n, c: df.groupBy("feature").agg((F.count_distinct("sample") / n).alias(c))
    both = share(tumour, n_tumour, "tumour").join(share(normal, n_normal, "normal"), "feature", "left").withColumn("normal", F.coalesce("normal", F.lit(0.0)))
    return both.filter((F.col("tumour") > least) & (F.col("normal") < most))


def marker_blocks(markers: DataFrame, levels: int) -> DataFrame:
    """(feature, block, n): markers (feature, level) fall into unique, shared or global blocks by the levels they mark."""
    f = markers.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("level")), "|").alias("levels"), F.count_distinct("level").alias("n"))
    return f.select("feature", F.when(F.col("n") == 1, F.concat(F.lit("unique:"), "levels")).when(F.col("n") == levels, "global").otherwise(F.concat(F.lit("shared:"), "levels")).alias("block"), "n")


def edge_classes(edges: DataFrame, least: float, fold: float) -> DataFrame:
    """edges (.., a, b) with a class: gained, lost, quantitative or unchanged."""
    a, b = F.col("a") >= least, F.col("b") >= least
    kind = F.when(~a & b, "gained").when(a & ~b, "lost").when(a & b & (F.abs(F.log2((F.col("b") + 1) / (F.col("a") + 1))) >= fold), "quantitative").otherwise("unchanged")
    return edges.withColumn("class", kind)


def shapley(scores: DataFrame, player: str, cell: str, metrics: list[str], bonus: float = 0.01) -> DataFrame:
    """(cell, player, value): each metric's credit goes to those that reach its maximum in the cell, in equal parts, with
    a bonus for each player that is passed; metrics add up.

    The credit of a player with p others below it and q at its level, in the game in which a coalition is worth the
    number of its members that lead, is 1 / (q + 1) + bonus * p; the players of a cell are few.
    """
    w = Window.partitionBy(cell)
    total = F.lit(0.0)
    for m in metrics:
        top = F.max(m).over(w)
        below = F.rank().over(w.orderBy(m)) - 1
        same = F.count("*").over(Window.partitionBy(cell, m))
        total = total + F.when(F.col(m) == top, F.lit(1.0) / same).otherwise(0.0) + below * bonus
    return scores.select(cell, player, total.alias("value"))


def arm_calls(bins: DataFrame, by: str, arm: str, value: str, sd: float, least: float, ratios: list[float]) -> DataFrame:
    """(by, arm, ratio, gain): the copy ratio that fits an arm's bins best, the smaller at a tie, and 1 unless twice its
    log-likelihood's lead over 1 is ``least`` or more.  Sums of squares about a ratio follow from n, the sum and the sum of
    squares.  Likelihoods and gains are compared to six places, so that the last bits of sums, which depend on the order
    of rows, don't decide."""
    g = bins.groupBy(by, arm).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    ll = lambda r: -(F.col("q") - F.col("s") * (2 * r) + F.col("n") * (r * r)) / (2 * sd * sd)
    best = F.array_max(F.array(*(F.struct(F.round(ll(r), 6).alias("near"), F.lit(-r).alias("neg"), ll(r).alias("ll")) for r in ratios)))
    gain = (best["ll"] - ll(1.0)) * 2
    return g.select(by, arm, F.when(F.round(gain, 6) >= least, -best["neg"]).otherwise(F.lit(1.0)).alias("ratio"), gain.alias("gain"))


def event_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(event, other, match) of events (event, junctions, sign) that share a junction: match, opposite or unknown."""
    left = a.select(F.col("event"), F.col("sign").alias("_a"), F.explode("junctions").alias("_j"))
    right = b.select(F.col("event").alias("other"), F.col("sign").alias("_b"), F.explode("junctions").alias("_j"))
    kind = F.when((F.col("_a") == 0) | (F.col("_b") == 0), "unknown").when(F.col("_a") == F.col("_b"), "match").otherwise("opposite")
    return left.join(right, "_j").select("event", "other", kind.alias("match")).distinct()


def population_coverage(alleles: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(race, coverage): the share of people with an allele of the list, by 1 - (1 - sum)^2."""
    f = frequencies.join(alleles.distinct(), "allele", "left_semi").groupBy("race").agg(F.least(F.lit(1.0), F.sum("frequency")).alias("f"))
    return f.select("race", (F.lit(1.0) - (F.lit(1.0) - F.col("f")) * (F.lit(1.0) - F.col("f"))).alias("coverage"))


def signatures(weights: DataFrame, least: float, top: int) -> DataFrame:
    """(ligand, gene, weight): each ligand's ``top`` weights over ``least``, scaled to length 1."""
    k = F.row_number().over(Window.partitionBy("ligand").orderBy(F.desc("weight"), "gene"))
    kept = weights.filter(F.col("weight") > least).withColumn("_k", k).filter(F.col("_k") <= top)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("ligand")))
    return kept.select("ligand", "gene", (F.col("weight") / length).alias("weight"))
