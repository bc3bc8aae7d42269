"""Counts per sample, cell and group: sums, filters, pseudobulks and normalisation.

Tables are long: only nonzero rows.  Means and fractions divide by the number of cells, which comes from the obs
table, never by the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_feature_sum(counts: DataFrame) -> DataFrame:
    """Total count of every (sample, feature)."""
    return counts.groupBy("sample", "feature").agg(F.sum("count").alias("count"))


def first_seen(counts: DataFrame, value: str) -> DataFrame:
    """Each feature's ``value`` in the first row by ord, the smallest of rows at the same place."""
    return counts.groupBy("feature").agg(F.min(F.struct("ord", value)).alias("x")).select("feature", F.col(f"x.{value}").alias(value))


def total_filter(counts: DataFrame, least: int) -> DataFrame:
    """Features whose total over all samples is ``least`` or more."""
    return counts.groupBy("feature").agg(F.sum("count").alias("total")).filter(F.col("total") >= least)


def any_sample_filter(counts: DataFrame, least: int) -> DataFrame:
    """Features with at least one sample whose count is over ``least`` - 1."""
    return sample_feature_sum(counts).groupBy("feature").agg(F.max("count").alias("top")).filter(F.col("top") > least - 1)


def presence_filter(values: DataFrame, group: str, column: str, value: str, floor: float, least: int) -> DataFrame:
    """Features that in any ``group`` have ``least`` or more columns with a value over ``floor``."""
    per = values.groupBy("feature", group).agg(F.count_if(F.col(value) > floor).alias("n"))
    return per.groupBy("feature").agg(F.max("n").alias("columns")).filter(F.col("columns") >= least)


def pseudobulk(matrix: DataFrame, obs: DataFrame, by: list[str], least_cells: int = 1) -> DataFrame:
    """(by..., gene, total, cells): sums over the cells of each group that has ``least_cells`` cells."""
    sizes = obs.groupBy(*by).agg(F.count("*").alias("cells")).filter(F.col("cells") >= least_cells)
    sums = matrix.join(obs, "cell").groupBy(*by, "gene").agg(F.sum("value").alias("total"))
    return sums.join(sizes, by)


def per_total(bulk: DataFrame, by: list[str], scale: float, name: str) -> DataFrame:
    """bulk with total / the group's sum * scale.  Groups may be few and large: their sums are an aggregate of partial
    sums, joined, and no group is one task's."""
    whole = bulk.groupBy(*by).agg(F.sum("total").alias("_whole"))
    return bulk.join(whole, by).withColumn(name, F.col("total") / F.col("_whole") * F.lit(scale)).drop("_whole")


def log2_cp10k(bulk: DataFrame, by: list[str]) -> DataFrame:
    """bulk with log2(total / group total * 1e4 + 1)."""
    return per_total(bulk, by, 1e4, "log2cp10k").withColumn("log2cp10k", F.log2(F.col("log2cp10k") + 1))


def cpm_and_ratio(counts: DataFrame, least_gene_cpm: float = 1.0) -> DataFrame:
    """(sample, gene, feature, count, cpm, ratio): ratio is the feature's share of its gene, null if the gene's CPM is low."""
    one = counts.groupBy("sample", "gene", "feature").agg(F.sum("count").alias("count"))
    genes = one.groupBy("sample", "gene").agg(F.sum("count").alias("_gene"))
    libraries = genes.groupBy("sample").agg(F.sum("_gene").alias("_library"))
    one = one.join(genes.join(libraries, "sample"), ["sample", "gene"])
    library, gene = F.col("_library"), F.col("_gene")
    return one.select("sample", "gene", "feature", "count", (F.col("count") * 1e6 / library).alias("cpm"), F.when(gene * 1e6 / library >= least_gene_cpm, F.col("count") / gene).alias("ratio"))


def mean_and_detection(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """(state, gene, mean, detection), zeros included."""
    sizes = obs.groupBy("state").agg(F.count("*").alias("n"))
    sums = matrix.join(obs, "cell").groupBy("state", "gene").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    return sums.join(F.broadcast(sizes), "state").select("state", "gene", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("detection"))


def qc_chain(matrix: DataFrame, least_genes: int, least_cells: int, least_total: int, special: Column, most_special: float) -> DataFrame:
    """(cell, genes, total, special_share) of cells that pass, in this order, each step on what the last one left:
    genes per cell, cells per gene, total per cell, share of ``special`` genes."""
    keep = lambda df, by, agg, least: df.join(df.groupBy(by).agg(agg.alias("_n")).filter(F.col("_n") >= least).select(by), by, "left_semi")
    m = keep(matrix, "cell", F.count("*"), least_genes)
    m = keep(m, "gene", F.count("*"), least_cells)
    per = m.groupBy("cell").agg(F.count("*").alias("genes"), F.sum("value").alias("total"), F.sum(F.when(special, F.col("value")).otherwise(0)).alias("_special"))
    per = per.filter(F.col("total") >= least_total).withColumn("special_share", F.col("_special") / F.col("total"))
    return per.filter(F.col("special_share") < most_special).drop("_special")


def group_mode(df: DataFrame, by: str, column: str) -> DataFrame:
    """The commonest ``column`` of each group, the smallest at a tie."""
    per = df.groupBy(by, column).agg(F.count("*").alias("_n"))
    top = per.groupBy(by).agg(F.max("_n").alias("_n"))
    return per.join(top, [by, "_n"]).groupBy(by).agg(F.min(column).alias(column))


def composition(obs: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share): counts and shares within the row."""
    per = obs.groupBy(row, column).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def with_total_row(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total) with a row for all, labelled TOTAL."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("TOTAL")))


def control_stats(counts: DataFrame, samples: int) -> DataFrame:
    """(feature, mean, std, mle, prevalence) over ``samples`` samples, absent ones being zero."""
    s = sample_feature_sum(counts)
    n = F.lit(samples)
    mean, square = F.sum("count") / n, F.sum(F.col("count") * F.col("count")) / n
    return s.groupBy("feature").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.least(F.sqrt(square), F.lit(1.0)).alias("mle"), (F.count("*") / n).alias("prevalence"))


def all_of(conditions: list[tuple[str, str, float]]) -> Column:
    """A filter from (column, operator, cutoff) criteria; a null attribute fails."""
    ops = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}
    return reduce(lambda a, b: a & b, (F.coalesce(getattr(F.col(c), ops[o])(v), F.lit(False)) for c, o, v in conditions), F.lit(True))
