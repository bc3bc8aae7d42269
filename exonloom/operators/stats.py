"""Test statistics per feature.  Tails come from functions.special; what SQL can express stays in SQL.

``values`` is long: (feature, sample, group, value).  Where zeros are implicit, numbers of cells come from obs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators.ranking import average_rank, top_k
from exonloom.sources.shared import cut, discard


def mann_whitney(values: DataFrame, feature: str, group: str, value: str, first: str) -> DataFrame:
    """(feature, n1, n2, u, ties): U of group ``first``; ties is the sum of t^3 - t over tied values."""
    ranked = values.withColumn("_r", average_rank([feature], value))
    mine = F.col(group) == first
    u = ranked.groupBy(feature).agg(F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"), F.sum(F.when(mine, F.col("_r"))).alias("_s"))
    ties = values.groupBy(feature, value).agg(F.count("*").alias("_t")).groupBy(feature).agg(F.sum(F.col("_t").cast("double") * F.col("_t") * F.col("_t") - F.col("_t")).alias("ties"))
    n1 = F.col("n1")
    return u.join(ties, feature).filter("n1 > 0 and n2 > 0").select(feature, "n1", "n2", (F.col("_s") - n1 * (n1 + 1) / 2).alias("u"), "ties")


def mann_whitney_z(u: DataFrame) -> DataFrame:
    """u with z: tie-corrected, with continuity correction towards the mean; null if all values tie."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, mean = n1 + n2, n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return u.withColumn("z", F.when(sigma > 0, (F.abs(F.col("u") - mean) - 0.5) / sigma))


def moderated_t(values: DataFrame, feature: str, group: str, value: str, first: str, shrink: float = 0.2) -> DataFrame:
    """(feature, n1, n2, diff, t, df): variances are averaged over the groups and shrunk to their median."""
    one = F.when(F.col(group) == first, F.col(value))
    two = F.when(F.col(group) != first, F.col(value))
    g = values.groupBy(feature).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), (F.avg(one) - F.avg(two)).alias("diff"), ((F.var_samp(one) + F.var_samp(two)) / 2).alias("_s2"))
    g = g.filter("n1 > 1 and n2 > 1")
    middle = g.agg(F.median("_s2").alias("_m"))
    s2 = F.col("_s2") * (1 - shrink) + F.col("_m") * shrink
    return g.crossJoin(F.broadcast(middle)).select(feature, "n1", "n2", "diff", (F.col("diff") / F.sqrt(s2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))


def moderated_paired_t(diffs: DataFrame, feature: str, value: str, prior_df: int = 4) -> DataFrame:
    """(feature, n, mean, t, df) of paired differences; variances are pooled with their median at ``prior_df``."""
    g = diffs.groupBy(feature).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("_s2")).filter("n > 1")
    middle = g.agg(F.median("_s2").alias("_m"))
    df = F.col("n") - 1
    s2 = (F.col("_m") * prior_df + F.col("_s2") * df) / (df + prior_df)
    return g.crossJoin(F.broadcast(middle)).select(feature, "n", "mean", (F.col("mean") / F.sqrt(s2 / F.col("n"))).alias("t"), (df + prior_df).alias("df"))


def marker_r(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """(gene, state, r): correlation of a gene's values, zeros included, with membership of the state."""
    n = F.lit(obs.count())
    sizes = obs.groupBy("state").agg(F.count("*").alias("m"))
    m = matrix.join(obs.select("cell", "state"), "cell")
    own = m.groupBy("gene", "state").agg(F.sum("value").alias("sxy"))
    all_ = m.groupBy("gene").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))
    top = F.col("sxy") * n - F.col("sx") * F.col("m")
    under = (F.col("sxx") * n - F.col("sx") * F.col("sx")).cast("double") * (F.col("m") * n - F.col("m") * F.col("m"))
    return own.join(all_, "gene").join(F.broadcast(sizes), "state").filter(under > 0).select("gene", "state", (top / F.sqrt(under)).alias("r"))


def overlaps(term_gene: DataFrame, query: DataFrame, background: int) -> DataFrame:
    """(term, k, term_size, query_size, background) for terms with a hit; ``query`` (gene) isn't cut to the background."""
    n = query.distinct().count()
    sizes = term_gene.distinct().groupBy("term").agg(F.count("*").alias("term_size"))
    hits = term_gene.distinct().join(query.distinct(), "gene").groupBy("term").agg(F.count("*").alias("k"))
    return hits.join(sizes, "term").select("term", "k", "term_size", F.lit(n).cast("bigint").alias("query_size"), F.lit(background).cast("bigint").alias("background"))


def enrichment_z(over: DataFrame) -> DataFrame:
    """over with z = (k - E) / sqrt(n f (1 - f)), 0 without variance."""
    f = F.col("term_size") / F.col("background")
    var = F.col("query_size") * f * (1 - f)
    return over.withColumn("z", F.when(var > 0, (F.col("k") - F.col("query_size") * f) / F.sqrt(var)).otherwise(F.lit(0.0)))


def cmh(tables: DataFrame, feature: str) -> DataFrame:
    """(feature, strata, numerator, variance) from 2x2 tables (a, b, c, d) per stratum; uninformative strata drop out."""
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r1, r2, c1, c2 = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("b") + F.col("d")
    ok = tables.filter((n > 1) & (r1 > 0) & (r2 > 0) & (c1 > 0) & (c2 > 0))
    var = r1.cast("double") * r2 * c1 * c2 / (n * n * (n - 1))
    return ok.groupBy(feature).agg(F.count("*").alias("strata"), F.sum(F.col("a") - r1 * c1 / n).alias("numerator"), F.sum(var).alias("variance")).filter("strata >= 2")


#: Features of a block, and numbers of its dense table, at most.
BLOCK, DENSE = 4096, 1 << 22


def _blocks(values: DataFrame, feature: str, sample: str, value: str) -> tuple[DataFrame, int]:
    """(_b, f, s, v): a feature's samples and values as arrays, in numbered blocks that follow the features' order; and
    the number of blocks."""
    rows = values.filter(F.col(value).isNotNull() & F.col(feature).isNotNull() & F.col(sample).isNotNull())
    g = cut(rows.groupBy(F.col(feature).alias("f")).agg(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).cast("double").alias("v"))).alias("a")))
    size = rows.agg(F.count_distinct(sample).alias("samples")).first()["samples"]
    n = max(1, math.ceil(g.count() / max(64, min(BLOCK, DENSE // max(size, 1)))))
    own = g.select("f", F.transform("a", lambda x: x["s"]).alias("s"), F.transform("a", lambda x: x["v"]).alias("v"))
    out = cut(own.repartitionByRange(n, "f").withColumn("_b", F.spark_partition_id()))
    discard(g)
    return out, n


def _dense(f: pd.DataFrame, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, values less the row's first, mask) of features by samples."""
    v, mask = np.zeros((len(f), len(place))), np.zeros((len(f), len(place)))
    x = np.zeros_like(v)
    for k, (s, a) in enumerate(zip(f.s, f.v)):
        at = [place[q] for q in s]
        v[k, at], x[k, at], mask[k, at] = a, a - a[0], 1.0
    return v, x, mask


def _correlations(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n, r) for runs of a's rows against all of b's; r is NaN without variance, n is -1 where ``same`` and
    y isn't after x.  Sums are of differences from a row's first value; where they cancel, a pair is taken by itself."""
    place = {s: k for k, s in enumerate(dict.fromkeys(q for f in (a, b) for s in f.s for q in s))}
    (va, xa, ma), (vb, xb, mb) = _dense(a, place), _dense(b, place)
    odd_a, odd_b = ~np.isfinite(xa), ~np.isfinite(xb)
    xa[odd_a], xb[odd_b] = 0.0, 0.0
    for lo in range(0, len(a), 128):
        x, m = xa[lo : lo + 128], ma[lo : lo + 128]
        n = m @ mb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            sx, sy, sxx, syy = x @ mb.T, m @ xb.T, (x * x) @ mb.T, m @ (xb * xb).T
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            flat = (vx <= 1e-9 * sxx) | (vy <= 1e-9 * syy)
            r = (x @ xb.T - sx * sy / n) / np.sqrt(vx * vy)
        r[(sxx == 0) | (syy == 0)] = np.nan
        for i, j in np.argwhere(flat & (sxx > 0) & (syy > 0) & (n > 1)).tolist():
            both = (m[i] * mb[j]) > 0
            p, q = va[lo + i][both], vb[j][both]
            p, q = p - p.mean() if np.ptp(p) else p * 0, q - q.mean() if np.ptp(q) else q * 0
            under = np.sqrt((p * p).sum() * (q * q).sum())
            r[i, j] = (p * q).sum() / under if under > 0 else np.nan
        if odd_a.any() or odd_b.any():
            r[(odd_a[lo : lo + 128] * 1.0) @ mb.T + m @ (odd_b * 1.0).T > 0] = np.nan
        if same:
            n[np.arange(len(b))[None, :] <= np.arange(lo, lo + len(x))[:, None]] = -1
        yield lo, n, np.clip(r, -1.0, 1.0)


def _by_blocks(values: DataFrame, feature: str, sample: str, value: str, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """run(x's block, y's block, whether they are one) over all pairs of blocks with x before y, features in order."""
    blocks, n = _blocks(values, feature, sample, value)
    others = F.sequence(F.lit(0), F.lit(n - 1))
    pairs = blocks.withColumn("_o", F.explode(others)).select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "f", "s", "v")

    def one(df: pd.DataFrame) -> pd.DataFrame:
        i, j = df._i.iloc[0], df._j.iloc[0]
        a, b = (df[df._b == k].sort_values("f", ignore_index=True) for k in (i, j))
        return run(a, b, i == j) if len(a) and len(b) else run(a[:0], b[:0], True)

    return pairs.groupBy("_i", "_j").applyInPandas(one, schema)


def correlated_pairs(values: DataFrame, feature: str, sample: str, value: str, least_common: int, top: int | None = None) -> DataFrame:
    """(x, y, n, r) for feature pairs x < y over the samples that both have, ``least_common`` or more; with ``top``, only
    those of each x whose |r|, to nine places, is largest, the smaller y at a tie, pairs without an r last.

    All pairs of features are taken, by blocks of dense tables; only what is asked for leaves a block.  A (feature,
    sample) has one value; without one it isn't there."""
    kind = values.schema[feature].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = []
        for lo, n, r in _correlations(a, b, same):
            if top is None:
                i, j = np.nonzero(n >= least_common)
            else:
                key = np.where(n >= least_common, np.nan_to_num(np.round(np.abs(r), 9), nan=-1.0), -2.0)
                rows, found = np.arange(len(n)), []
                for _ in range(min(top, len(b))):
                    at = key.argmax(axis=1)
                    some = key[rows, at] > -2.0
                    found.append((rows[some], at[some]))
                    key[rows, at] = -2.0
                i, j = (np.concatenate(c) for c in zip(*found))
            out.append((a.f.to_numpy()[lo + i], b.f.to_numpy()[j], n[i, j].astype("int64"), r[i, j]))
        x, y, n, r = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [], [])
        return pd.DataFrame({"x": x, "y": y, "n": n, "r": r})

    pairs = _by_blocks(values, feature, sample, value, run, f"x {kind}, y {kind}, n bigint, r double").withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
    return pairs if top is None else top_k(pairs, ["x"], [F.desc(F.round(F.abs("r"), 9)), F.asc("y")], top, "_k").drop("_k")


def correlated_partners(values: DataFrame, feature: str, sample: str, value: str, least_common: int, least_r: float) -> DataFrame:
    """(feature, n): with how many others a feature correlates over ``least_r``, as in correlated_pairs(); if any."""
    kind = values.schema[feature].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        mine, theirs = np.zeros(len(a), "int64"), np.zeros(len(b), "int64")
        for lo, n, r in _correlations(a, b, same):
            over = (n >= least_common) & (r > least_r)
            mine[lo : lo + len(n)] += over.sum(axis=1)
            theirs += over.sum(axis=0)
        return pd.DataFrame({"f": pd.concat([a.f, b.f], ignore_index=True), "n": np.concatenate([mine, theirs])})

    counts = _by_blocks(values, feature, sample, value, run, f"f {kind}, n bigint")
    return counts.groupBy(F.col("f").alias(feature)).agg(F.sum("n").alias("n")).filter("n > 0")


def tf_idf(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """(state, gene, score): (share in the state + 1e-5) * -log10(share in all + 1e-5)."""
    n = F.lit(obs.count())
    sizes = obs.groupBy("state").agg(F.count("*").alias("m"))
    own = matrix.join(obs.select("cell", "state"), "cell").groupBy("state", "gene").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy("gene"))
    return own.join(F.broadcast(sizes), "state").select("state", "gene", ((F.col("k") / F.col("m") + 1e-5) * -F.log10(total / n + 1e-5)).alias("score"))
