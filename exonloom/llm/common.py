"""What the operators share: column picking, held-out rows, connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.sources.shared import cut, discard, merged

__all__ = ["collected", "connected_components", "crc_remainder", "cut", "discard", "merged", "picked", "trimmed"]


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns under the operator's own names, so that no other column of ``df`` can clash."""
    return df.select(*(F.col(f"`{c}`").alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


def crc_remainder(column: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; null for a null id."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % F.lit(by)


def collected(df: DataFrame) -> None:
    """Have the driver collect its garbage: plans of steps that are over go, its heap shrinks again, and Spark drops
    the shuffle files and broadcasts that only they referred to."""
    df.sparkSession.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Give the memory that this process has freed back to the system: a worker that waits for its next task, or whose
    batch is done, would keep it otherwise, beside what the executor's other processes take."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b: bigint) the smallest node that it can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) on tables in the shared folder. Each step is a
    minimum per node, combined before the shuffle, joined back to the edges by a join that adaptive execution can
    split, so a node with very many neighbours is no task's whole burden; no side is broadcast.  Rounds go on until nothing changes; if
    that takes over ``most_rounds``, far more than the logarithm of any number of nodes, it is an error.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(most_rounds):
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(merged(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # small star: u and its neighbours below it are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        after = cut(small.filter("u > v").distinct())
        discard(e)
        collected(after)
        e = after
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
