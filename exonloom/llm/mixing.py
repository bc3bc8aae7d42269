"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only.

A source's weight over training time u in [0, 1] is target * (1 + g * (2u - 1)): it rises with u for a positive tilt
g, falls for a negative one.  Integrated, the source has asked for D(u) = target * ((1 - g) * u + g * u * u) words by
time u, and D(1) = target.  Its documents stand in a fixed shuffled order, gone through up to ``repeats`` times; a
document at the running total c is due at the time u with D(u) = c, which the quadratic's root gives.  Sorting all
documents by u, in ranges, is the training order.

Running totals never gather a source in one task: documents fall into about sqrt(n) ranges of their shuffled order,
a range's total comes from a partial aggregate, and only ranges are added up per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.llm.common import cut

#: What separates words, in the form that Java's and DuckDB's regular expressions share.
WORD = r"[^\x20\x09-\x0D]+"
#: Positions are counted in billionths of the training time.
SCALE = 1_000_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    cols = [
        F.col(f"`{id_col}`").alias("doc"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")).alias("key"),
    ]
    return docs.select(*cols, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int, tilts: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target, tilt): sources by code point, null last, with weights in turn, share ``share`` of
    all sizes.  Targets stop at ``repeats`` times their source's size; the excess goes to the others by weight.

    Taken in the order of limit / weight, the sources that stop are a prefix: a source stops as long as its own
    limit is not above its part of what the ones before it leave.  The table has a row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(rank) - 1
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (F.col("place") % len(xs) + 1).cast("int"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", place)
    s = s.withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("most") / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(share) - so_far("most")) / (F.sum("weight").over(every) - so_far("weight"))
    s = s.withColumn("level", level).withColumn("turn", F.row_number().over(Window.orderBy("ratio", "place")))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("turn", "level"))).over(every)
    s = s.withColumn("first", first)
    stops = F.col("first").isNull() | (F.col("turn") < F.col("first.turn"))
    return s.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.col("weight") * F.col("first.level")).alias("target"), "tilt")


def due(words: Column) -> Column:
    """The time, in parts of SCALE, at which the source has asked for ``words``; null if that is never."""
    y = words / F.col("target")
    u = (y * 2) / ((F.lit(1.0) - F.col("tilt")) + F.sqrt((F.lit(1.0) - F.col("tilt")) * (F.lit(1.0) - F.col("tilt")) + F.col("tilt") * 4 * y))
    return F.when(words < F.floor("target"), F.floor(u * SCALE))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, tilts: tuple[float, ...] = (0.5, 0.0, -0.5), carry: bool = False
) -> DataFrame:
    """(doc, size, source_size, target, taken, positions[, row]) for every row of ``docs``.

    ``taken`` is how many of the row's words the mix takes, over all passes; a source's add up to its target rounded
    down, and only the document at which the last pass stops is taken in part.  ``positions`` has the time at which
    each pass that takes words of the row begins it.  ``row`` holds the input row if ``carry``.

    Defined results: a null or empty text has size 0 and nothing taken; null sources are one source, the last.  The
    shuffled order is that of the ids' hashes, for null ids of their texts'; ties there go by id and size, so that
    reruns agree and repeated rows, which stand side by side, each count.  An empty table gives an empty result.
    """
    narrow = cut(_keyed(docs, id_col, text_col, source_col, False))
    targets = cut(source_targets(narrow, weights, share, repeats, tilts))
    ranges = max(1, math.isqrt(narrow.count()))
    range_of = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(float(1 << 32))).alias("range")
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    parts = narrow.select("source", "size", range_of).groupBy("source", "range").agg(F.sum("size").alias("part"))
    begin = F.sum("part").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("source", "range", F.coalesce(begin, F.lit(0)).alias("base"))
    bases = bases.join(targets, same(bases, targets, "source")).drop(targets["source"])
    rows = (_keyed(docs, id_col, text_col, source_col, True) if carry else narrow).withColumn("range", range_of)
    rows = rows.join(bases, same(rows, bases, "source", "range")).drop(bases["source"]).drop(bases["range"])
    own = Window.partitionBy("source", "range").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    starts = [F.col("begin") + F.col("source_size") * p for p in range(repeats)]
    of_pass = lambda c: F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - c)).cast("bigint")
    taken = sum((of_pass(c) for c in starts[1:]), of_pass(starts[0]))
    positions = F.filter(F.array(*(F.when(F.col("size") > 0, due(c.cast("double"))) for c in starts)), lambda x: x.isNotNull())
    return rows.select("doc", "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"), *(["row"] if carry else []))


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix_sources(carry=True), one for each pass that takes them, range-sorted by position, then by id and
    size.  A row that a pass takes in part is there as a whole.  Written to files, these and their rows are in order."""
    order = ["position", "doc", "size"]
    passes = mixed.select("row", "doc", "size", F.explode("positions").alias("position"))
    return passes.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST([0.5, 0.0, -0.5][place % 3 + 1] AS DOUBLE) AS tilt,
             source_size * CAST(2 AS DOUBLE) AS most FROM p),
l AS (SELECT *, most / weight AS ratio, row_number() OVER o AS turn,
             ((SELECT CAST(sum(source_size) AS BIGINT) FROM s) * CAST(1.5 AS DOUBLE)
               - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, place)),
f AS (SELECT min(turn) AS turn, arg_min(level, turn) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, tilt,
             CASE WHEN f.turn IS NULL OR l.turn < f.turn THEN most ELSE weight * f.level END AS target
      FROM l, f),
c AS (SELECT d.*, t.source_size, t.target, t.tilt,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - b)) + greatest(0, least(size, floor(target) - source_size - b)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND b < floor(target)
            THEN CAST(floor(b / target * 2 / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + tilt * 4 * (b / target))) * 1000000000) AS BIGINT) ELSE -1 END AS position
FROM c
"""
