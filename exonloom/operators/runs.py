"""Runs, windows and sweeps along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, by: list[str], order: str, flag: Column, least: int = 1) -> DataFrame:
    """(by..., first, last, n) of maximal runs of rows with ``flag``, of ``least`` rows or more."""
    own, flagged = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, "_flag").orderBy(order)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_run", F.row_number().over(own) - F.row_number().over(flagged)).filter("_flag")
    return marked.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_run")


def hysteresis(df: DataFrame, by: list[str], order: str, value: str, low: float, high: float, least: int) -> DataFrame:
    """Runs over ``low`` of ``least`` rows or more in which some row is over ``high``: (by..., first, last, n, top)."""
    own, flagged = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, "_flag").orderBy(order)
    marked = df.withColumn("_flag", F.col(value) > low)
    marked = marked.withColumn("_run", F.row_number().over(own) - F.row_number().over(flagged)).filter("_flag")
    out = marked.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.max(value).alias("top"))
    return out.filter((F.col("n") >= least) & (F.col("top") > high)).drop("_run")


def around(by: list[str], order: str, half: int):
    """A row frame of ``half`` rows on either side, cut at the group's ends."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)


def upper_median(by: list[str], order: str, value: str, half: int) -> Column:
    """The element at n // 2 (from 0) of the sorted frame: of an even number, the upper of the middle two."""
    s = F.sort_array(F.collect_list(value).over(around(by, order, half)))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def gene_windows(df: DataFrame, by: str, order: str, value: str, size: int, stride: int, flush: bool = True) -> DataFrame:
    """(by, window_start, n, mean): windows of ``size`` rows every ``stride`` rows; with ``flush`` a last one ends at
    the group's end.  Groups with fewer rows than ``size`` have none.

    A row goes to the windows that hold it, which are size / stride + 1 at most, instead of a join with all windows.
    """
    n = F.count("*").over(Window.partitionBy(by))
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("_n", n).filter(F.col("_n") >= size)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / F.lit(float(stride))).cast("bigint") * stride)
    high = F.least(F.floor(F.col("_i") / stride) * stride, F.floor((F.col("_n") - size) / stride) * stride)
    starts = F.when(low <= high, F.sequence(low.cast("bigint"), F.greatest(low, high).cast("bigint"), F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    if flush:
        last = (F.col("_n") - size).cast("bigint")
        starts = F.when((F.col("_i") >= last) & (last % stride != 0), F.array_append(starts, last)).otherwise(starts)
    rows = placed.withColumn("window_start", F.explode(starts))
    return rows.groupBy(by, "window_start").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def multiscale_windows(df: DataFrame, by: str, order: str, value: str, scales: list[tuple[int, int]]) -> DataFrame:
    """(size, by, window_start, n, mean): gene_windows() of several sizes and strides, without flushed ones."""
    out = [gene_windows(df, by, order, value, size, stride, flush=False).select(F.lit(size).alias("size"), by, "window_start", "n", "mean") for size, stride in scales]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]



def merged_intervals(df: DataFrame, by: str, gap: int = 0) -> DataFrame:
    """(by, start, end, n): intervals joined while the next begins no later than the furthest end so far plus ``gap``."""
    before = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = df.withColumn("_reach", F.max("end").over(before)).withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("int"))
    return new.withColumn("_k", F.sum("_new").over(up_to)).groupBy(by, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_k")


def coverage_runs(df: DataFrame, by: str, least: int) -> DataFrame:
    """(by, start, end): maximal spans that ``least`` or more intervals cover, by a sweep over +1 and -1 steps."""
    steps = df.select(by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(by, "x.at", "x.d")
    steps = steps.groupBy(by, "at").agg(F.sum("d").alias("d"))
    own = Window.partitionBy(by).orderBy("at")
    deep = steps.withColumn("depth", F.sum("d").over(own)).withColumn("next", F.lead("at").over(own)).withColumn("_on", F.col("depth") >= least)
    edges = deep.withColumn("_before", F.coalesce(F.lag("_on").over(own), F.lit(False))).filter(F.col("_on") != F.col("_before"))
    ends = edges.withColumn("end", F.lead("at").over(own))
    return ends.filter("_on").select(by, F.col("at").alias("start"), "end")
