"""Interval, lookup, containment and nearest joins.

Interval joins bin the axis, so that Spark sees an equi-join; bins are as wide as the spans are long, and a pair is
emitted in the bin of its overlap's start only, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _binned(df: DataFrame, width: int, start: str, end: str) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int, names: tuple[str, str, str, str] = ("a_start", "a_end", "b_start", "b_end")) -> DataFrame:
    """Rows of a and b with equal ``on`` whose half-open spans share more than an end point.  Columns other than
    ``on`` must differ between a and b."""
    a_start, a_end, b_start, b_end = names
    both = _binned(a, width, a_start, a_end).join(_binned(b, width, b_start, b_end), [*on, "_bin"])
    first = F.floor(F.greatest(a_start, b_start) / width) == F.col("_bin")
    return both.filter((F.col(a_end) > F.col(b_start)) & (F.col(a_start) < F.col(b_end)) & first).drop("_bin")


def point_in_interval(points: DataFrame, spans: DataFrame, on: list[str], point: str, width: int, value: str, rank: str) -> DataFrame:
    """points with ``value`` of the lowest-ranked span that holds the point; null if none does.  Points without a span
    stay; spans are binned, points fall into one bin."""
    key = [*on, point]
    asked = points.select(*key).distinct().withColumn("_bin", F.floor(F.col(point) / width))
    hits = asked.join(_binned(spans.select(*on, "start", "end", value, rank), width, "start", "end"), [*on, "_bin"])
    hits = hits.filter((F.col(point) >= F.col("start")) & (F.col(point) < F.col("end")))
    best = hits.groupBy(*key).agg(F.min(F.struct(rank, value)).alias("_b")).select(*key, F.col(f"_b.{value}").alias(value))
    return points.join(best, key, "left")


def with_fallback(df: DataFrame, first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """df with ``value`` looked up in ``first``, or in ``second`` where that has none."""
    a, b = first.select(*on, F.col(value).alias("_a")), second.select(*on, F.col(value).alias("_b"))
    return df.join(a, on, "left").join(b, on, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of every label."""
    parts = df.select(label, F.posexplode(vector).alias("_i", "_x")).groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, refs: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, score): the label of the centroid of largest cosine, the smaller label at a tie.  There are as many
    centroids as labels; Spark broadcasts them if they are small enough."""
    wide = df.select(id_col, vector).crossJoin(refs.select(F.col(label).alias("_l"), "centroid"))
    score = cosine(F.col(vector), F.col("centroid"))
    best = wide.groupBy(id_col).agg(F.max(F.struct(score.alias("s"), (-F.col("_l")).alias("l"))).alias("_b"))
    return best.select(id_col, (-F.col("_b.l")).alias(label), F.col("_b.s").alias("score"))


def contained_tokens(a: DataFrame, b: DataFrame, key: str, short: str, long: str) -> DataFrame:
    """a's columns and b's ``key`` for pairs whose ``short`` token list is a consecutive part of the ``long`` one.

    Pairs are found by the short list's rarest token, so that only lists which hold it are compared; token lists are
    joined to the pairs after that, not carried along with every token.
    """
    held = b.select(key, F.explode(F.array_distinct(long)).alias("_t"))
    asked = a.select(F.explode(F.array_distinct(short)).alias("_t")).distinct()
    held = held.join(asked, "_t", "left_semi")
    often = held.groupBy("_t").agg(F.count("*").alias("_df"))
    parts = a.withColumn("_t", F.explode(F.array_distinct(short))).join(often, "_t")
    rare = parts.groupBy(*a.columns).agg(F.min(F.struct("_df", "_t")).alias("_r")).select(*a.columns, F.col("_r._t").alias("_t"))
    pairs = rare.join(held, "_t").drop("_t").join(b.select(key, long), key)
    # whole tokens are compared, whatever characters they hold
    n, m = F.size(short), F.size(long)
    starts = F.when(m >= n, F.sequence(F.lit(1), m - n + 1)).otherwise(F.array().cast("array<int>"))
    found = F.exists(starts, lambda k: (F.element_at(F.col(long), k) == F.element_at(F.col(short), 1)) & (F.slice(F.col(long), k, n) == F.col(short)))
    return pairs.filter(found).select(*a.columns, key)
