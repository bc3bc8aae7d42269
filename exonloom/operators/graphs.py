"""Closures and ranks of graphs, by iterated joins whose lineage is cut in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.sources.shared import cut, discard


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, descendant, depth): every pair that parent -> child edges connect, with the shortest depth.

    Paths double in each round, so a graph of depth d takes log2(d) joins.
    """
    known = cut(edges.filter("parent != child").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")).distinct())
    before = -1
    for _ in range(most):
        a = known.select("ancestor", F.col("descendant").alias("_m"), F.col("depth").alias("_d"))
        b = known.select(F.col("ancestor").alias("_m"), "descendant", F.col("depth").alias("_e"))
        longer = a.join(b, "_m").select("ancestor", "descendant", (F.col("_d") + F.col("_e")).alias("depth")).filter("ancestor != descendant")
        known = cut(known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        mark = known.agg(F.count("*"), F.sum("depth")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"paths still grow after {most} rounds")
    return known


def pagerank(edges: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(node, rank) over directed edges (source, target); ranks add up to 1, dangling nodes give to all.  Rounds go on
    until the ranks' changes add up to ``tolerance`` or less; if ``rounds`` don't get there, it is an error."""
    e = cut(edges.select("source", "target").distinct())
    nodes = cut(e.select(F.col("source").alias("node")).union(e.select("target")).distinct())
    n = nodes.count()
    degree = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out"))
    nodes = cut(nodes.join(degree, "node", "left"))
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        with_out = nodes.join(ranks, "node")
        loose = with_out.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = with_out.filter("out is not null").select(F.col("node").alias("source"), (F.col("rank") / F.col("out")).alias("part"))
        got = e.join(given, "source").groupBy(F.col("target").alias("node")).agg(F.sum("part").alias("s"))
        new = cut(nodes.select("node").join(got, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + (F.coalesce("s", F.lit(0.0)) + F.lit(loose / max(n, 1))) * damping).alias("rank")))
        moved = new.join(ranks.withColumnRenamed("rank", "_old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] or 0.0
        discard(ranks)
        ranks = new
        if moved <= tolerance:
            return ranks
    raise RuntimeError(f"ranks still move by {moved} after {rounds} rounds")
