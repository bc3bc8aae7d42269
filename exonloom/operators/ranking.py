"""Ranks, top-k and false discovery rates, each with a total order for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.sources.shared import cut


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group; the filter on row_number lets Spark cut groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def average_rank(by: list[str], value: str, descending: bool = False) -> Column:
    """Rank with ties averaged."""
    first = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value))
    return F.rank().over(first) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def empirical_p(by: list[str], value: str) -> Column:
    """Upper-tail share: how many of the group are at least as large."""
    n = F.count("*").over(Window.partitionBy(*by))
    at_least = F.count("*").over(Window.partitionBy(*by).orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, 0))
    return at_least / n


def benjamini_hochberg(by: list[str], p: str, *ties: str) -> Column:
    """q = the least p * n / rank over this and all larger p, at most 1; null p has none and isn't counted."""
    some = F.col(p).isNotNull()
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, some).orderBy(p, *ties))
    raw = F.when(some, F.col(p) * n / rank)
    return raw  # the caller takes the running minimum: windows don't nest


def with_q(df: DataFrame, by: list[str], p: str, ties: list[str], name: str = "q") -> DataFrame:
    """df with Benjamini-Hochberg q values within each group; without groups, over all rows by ranges of p.

    Without groups q comes back by p, so ``df`` is computed once: sums in another order would give a p of another last
    bit, which finds no q."""
    if not by:
        df = cut(df)
        q = q_of_all(df, df.select(p).filter(F.col(p).isNotNull()).distinct(), p).select(F.col(p).alias("_p"), F.col("q").alias(name))
        return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")
    raw = df.withColumn("_raw", benjamini_hochberg(by, p, *ties))
    later = Window.partitionBy(*by).orderBy(F.desc_nulls_last(p), *(F.desc(t) for t in ties)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(later)))).drop("_raw")


def q_of_all(every: DataFrame, tested: DataFrame, value: str = "p") -> DataFrame:
    """tested with q: for shortlisted tests the Benjamini-Hochberg value that their p has among all p values.

    Distinct p values are few where tests are many of a kind; ranks come from counts per p in ranges of p, whose sums
    are added up, so no task sees all.  A p must come out the same, to its last bit, each time that it is computed."""
    c = every.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("p")).agg(F.count("*").alias("n")).withColumn("_range", F.floor(F.col("p") * 1000))
    sums = c.groupBy("_range").agg(F.sum("n").alias("_n"))  # 1,001 ranges at most
    w = Window.orderBy("_range")
    sums = sums.select("_range", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    own = Window.partitionBy("_range").orderBy("p")
    r = c.join(F.broadcast(sums), "_range").withColumn("_raw", F.col("p") * F.col("_all") / (F.col("_before") + F.sum("n").over(own)))
    later = Window.partitionBy("_range").orderBy(F.desc("p"))
    least = r.groupBy("_range").agg(F.min("_raw").alias("_least"))
    after = least.select("_range", F.min("_least").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    q = r.withColumn("_own", F.min("_raw").over(later)).join(F.broadcast(after), "_range").select("p", F.least(F.lit(1.0), F.col("_own"), F.coalesce("_after", F.lit(1.0))).alias("q"))
    return tested.join(q.withColumnRenamed("p", value), value)


def kth_range(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(by, low, high): the k-th smallest and k-th largest value of each group; null if it has fewer.  Ranks are cut at k
    before the shuffle."""
    place = lambda order: F.row_number().over(Window.partitionBy(by).orderBy(order))
    ends = [df.select(by, F.col(value).alias(name), place(order).alias("_k")).filter(F.col("_k") <= k).filter(F.col("_k") == k).drop("_k") for name, order in (("low", F.asc_nulls_last(value)), ("high", F.desc_nulls_last(value)))]
    return df.select(by).distinct().join(ends[0], by, "left").join(ends[1], by, "left")
