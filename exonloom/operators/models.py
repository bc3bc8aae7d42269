"""Fitted models: regressions per target, factorisation, deconvolution, survival, gene-set runs, communities.

A target's or set's rows go to one task, as many as it has samples; what crosses targets is summed in Spark first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.sources.shared import cut


def ridge_normal(rows: DataFrame, features: list[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge weights and intercept from one pass: sums of products are added up in Spark, a matrix of
    len(features) + 2 squared comes to the driver."""
    cols = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    n = len(cols)
    sums = rows.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n))).first()
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0
    count = max(m[0, 0], 1.0)
    centred = m - np.outer(m[0], m[0]) / count
    w = np.linalg.solve(centred[1:-1, 1:-1] + alpha * np.eye(n - 2), centred[1:-1, -1])
    return w, float((m[0, -1] - w @ m[0, 1:-1]) / count)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, steps: int = 500, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Coordinate descent on (1 / 2n) |y - xw - b|^2 + alpha * l1 * |w|_1 + alpha * (1 - l1) / 2 * |w|^2."""
    n, p = x.shape
    mx, my = x.mean(0), y.mean()
    xc, r, w = x - mx, y - my, np.zeros(p)
    norm = (xc * xc).sum(0) / n
    for _ in range(steps):
        most = 0.0
        for j in range(p):
            if norm[j] == 0:
                continue
            z = xc[:, j] @ r / n + norm[j] * w[j]
            new = np.sign(z) * max(abs(z) - alpha * l1, 0) / (norm[j] + alpha * (1 - l1))
            if new != w[j]:
                r -= xc[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < tolerance:
            break
    return w, float(my - mx @ w)


def per_target_elastic_net(levels: DataFrame, targets: DataFrame, alpha: float, l1: float, most: int = 5) -> DataFrame:
    """(target, gene, weight, intercept): for each target the ``most`` genes of largest absolute correlation over common
    samples, then an elastic net on them.  levels is (sample, gene, value), targets (sample, target, y)."""
    both = targets.join(levels, "sample")
    r = both.groupBy("target", "gene").agg(F.corr("value", "y").alias("r")).filter("r is not null")
    k = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs("r")), "gene"))
    chosen = r.withColumn("_k", k).filter(F.col("_k") <= most).select("target", "gene")
    rows = both.join(chosen, ["target", "gene"]).select("target", "sample", F.col("gene").cast("string").alias("gene"), F.col("value").cast("double").alias("value"), F.col("y").cast("double").alias("y"))
    kind = rows.schema["target"].dataType.simpleString()

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        x = df.pivot_table(index="sample", columns="gene", values="value", fill_value=0.0)
        y = df.groupby("sample").y.first().reindex(x.index)
        w, b = elastic_net(x.to_numpy(float), y.to_numpy(float), alpha, l1)
        return pd.DataFrame({"target": df.target.iloc[0], "gene": x.columns, "weight": w, "intercept": b})

    return rows.groupBy("target").applyInPandas(fit, f"target {kind}, gene string, weight double, intercept double")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        g = a.T @ (b - a @ x)
        if on.all() or g[~on].max() <= 1e-10:
            break
        on[np.flatnonzero(~on)[np.argmax(g[~on])]] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                break
            bad = on & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
        x = s
    return x


def deconvolved(mixtures: DataFrame, profiles: DataFrame) -> DataFrame:
    """(sample, state, fraction) from mixtures (sample, gene, value) and profiles (state, gene, mean): a sample is one task's."""
    rows = mixtures.join(profiles, "gene")
    kind = rows.schema["sample"].dataType.simpleString()

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        a = df.pivot_table(index="gene", columns="state", values="mean", fill_value=0.0)
        x = nnls(a.to_numpy(float), df.groupby("gene").value.first().reindex(a.index).to_numpy(float))
        return pd.DataFrame({"sample": df["sample"].iloc[0], "state": a.columns, "fraction": x / max(x.sum(), 1e-300)})

    return rows.groupBy("sample").applyInPandas(fit, f"sample {kind}, state string, fraction double")


def cox_slope(time: np.ndarray, event: np.ndarray, x: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and its standard error of a one-covariate Cox model, Breslow ties, by Newton steps."""
    by = np.argsort(-time, kind="stable")
    time, event, x = time[by], event[by].astype(bool), x[by].astype(float)
    last = np.searchsorted(-time, -time, side="right") - 1  # the risk set of a time ends with its last tie
    b, h = 0.0, 0.0
    for _ in range(steps):
        w = np.exp(b * (x - x.mean()))
        s0, s1, s2 = (np.cumsum(w * x**k)[last][event] for k in (0, 1, 2))
        g, h = (x[event] - s1 / s0).sum(), (s2 / s0 - (s1 / s0) ** 2).sum()
        if h <= 0:
            break
        step = np.clip(g / h, -1, 1)
        b += step
        if abs(step) < 1e-10:
            break
    return float(b), float(1 / np.sqrt(h)) if h > 0 else float("nan")


def cox(rows: DataFrame, feature: str) -> DataFrame:
    """(feature, beta, se) per feature of (feature, time, event, x)."""
    kind = rows.schema[feature].dataType.simpleString()

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        b, se = cox_slope(df.time.to_numpy(float), df.event.to_numpy(), df.x.to_numpy(float))
        return pd.DataFrame({feature: [df[feature].iloc[0]], "beta": [b], "se": [se]})

    return rows.groupBy(feature).applyInPandas(fit, f"{feature} {kind}, beta double, se double")


def running_sum(ranked: np.ndarray, hits: np.ndarray) -> float:
    """Enrichment score of a ranked list: the largest deviation of the weighted running sum."""
    if not hits.any() or hits.all():
        return 0.0
    w = np.abs(ranked) * hits
    path = np.cumsum(np.where(hits, w / max(w.sum(), 1e-300), -1.0 / (~hits).sum()))
    return float(path[np.argmax(np.abs(path))])


def ranked_list(scores: DataFrame) -> DataFrame:
    """(gene, score, place) of scores (gene, score): places from 0 by score, largest first, then gene.  The sorted table
    is written; a row's place is the number of rows in the files before its own and in its own before it."""
    t = cut(scores.select("gene", "score").orderBy(F.desc("score"), "gene"))
    t = t.select("gene", "score", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint").alias("_part"), F.col("_metadata.row_index").alias("_row"))
    sizes = t.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per written file
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return t.join(F.broadcast(sizes), "_part").select("gene", "score", (F.col("_before") + F.col("_row")).alias("place"))


def gsea(scores: DataFrame, term_gene: DataFrame, permutations: int = 200, seed: int = 1) -> DataFrame:
    """(term, es, nes, p) of terms over scores (gene, score), ranked by score, then gene.

    Permutations need the score of any place, so the ranked scores are broadcast, 8 bytes a gene, however many there
    are; genes and places stay in Spark.  A term's task gets the places of the term's genes alone."""
    order = ranked_list(scores)
    marked = term_gene.select("term", "gene").distinct().join(order, "gene").select("term", "place")
    ranked = order.orderBy("place").select(F.col("score").cast("double").alias("score")).toArrow().column("score").to_numpy()
    known = scores.sparkSession.sparkContext.broadcast(ranked)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        s = known.value
        hits = np.zeros(len(s), bool)
        hits[df.place.to_numpy()] = True
        es, rng = running_sum(s, hits), np.random.default_rng(seed)
        null = np.array([running_sum(s, rng.permutation(hits)) for _ in range(permutations)])
        side = null[null * es > 0]
        return pd.DataFrame({"term": [df.term.iloc[0]], "es": [es], "nes": [es / max(np.abs(side).mean(), 1e-300) if len(side) else 0.0], "p": [(np.sum(np.abs(side) >= abs(es)) + 1) / (len(side) + 1)]})

    return marked.groupBy("term").applyInPandas(run, "term string, es double, nes double, p double")


def nmf(x: np.ndarray, rank: int, steps: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """x ~ w h with non-negative factors, by multiplicative updates from a seeded start."""
    rng = np.random.default_rng(seed)
    x = np.maximum(x, 0)
    scale = np.sqrt(x.mean() / rank) if x.size else 1.0
    w, h = scale * rng.random((x.shape[0], rank)) + 1e-6, scale * rng.random((rank, x.shape[1])) + 1e-6
    for _ in range(steps):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: in each round a node takes the label that most of its neighbours' weight
    has, the smallest at a tie.  edges is (a, b, weight), each pair once."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("near"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"), "weight")))
    labels = both.select("node").distinct().withColumn("community", F.col("node"))
    before = None
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("near"), "community"), "near").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        own = labels.withColumn("w", F.lit(1e-9))  # a node keeps its label where it has no better one
        votes = votes.unionByName(own.select("node", "community", "w")).groupBy("node", "community").agg(F.sum("w").alias("w"))
        labels = cut(votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("x")).select("node", (-F.col("x.c")).alias("community")))
        mark = labels.agg(F.sum(F.xxhash64("node", "community").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    return labels


def prioritised_terms(terms: pd.DataFrame, ancestors: dict[str, set[str]], least_z: float = 1.96, most_fdr: float = 0.1, least_overlap: int = 3) -> list[str]:
    """Significant terms by (p, -|z|), each unless a selected term is its ancestor or descendant.

    A pass over the significant terms only, of which there are as many as a report holds.
    """
    ok = terms[(terms.z >= least_z) & (terms.fdr <= most_fdr) & (terms.k >= least_overlap)]
    chosen: list[str] = []
    for row in ok.assign(_z=-ok.z.abs()).sort_values(["p", "_z", "term"]).itertuples():
        near = ancestors.get(row.term, set())
        if not any(c in near or row.term in ancestors.get(c, set()) for c in chosen):
            chosen.append(row.term)
    return chosen
