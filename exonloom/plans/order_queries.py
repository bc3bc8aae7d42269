"""Queries on ranks, runs, windows and sets, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from exonloom.operators import ranking as K
from exonloom.operators import runs as U
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import COUNTS, INTERVALS, MATRIX, OBS, POSITIONS

R = lambda c, n=6: F.round(c, n)
GENES = f"(SELECT sample, gene, CAST(sum(count) AS BIGINT) AS total FROM {COUNTS} GROUP BY 1, 2)"


def genes(s, d):
    return A.counts(s, d).groupBy("sample", "gene").agg(F.sum("count").alias("total"))


@query("topk_per_group", f"SELECT * FROM (SELECT sample, gene, total, CAST(row_number() OVER (PARTITION BY sample ORDER BY total DESC, gene) AS INTEGER) AS place FROM {GENES}) WHERE place <= 5")
def topk_per_group(s, d):
    return K.top_k(genes(s, d), ["sample"], [F.desc("total"), F.asc("gene")], 5)


@query("rank_first", f"SELECT sample, gene, CAST(row_number() OVER (PARTITION BY sample ORDER BY total, gene) AS INTEGER) AS place FROM {GENES}")
def rank_first(s, d):
    return genes(s, d).select("sample", "gene", F.row_number().over(W.partitionBy("sample").orderBy("total", "gene")).alias("place"))


@query("rank_average", f"SELECT sample, gene, rank() OVER (PARTITION BY sample ORDER BY total) + (count(*) OVER (PARTITION BY sample, total) - 1) / 2.0 AS r FROM {GENES}")
def rank_average(s, d):
    return genes(s, d).select("sample", "gene", K.average_rank(["sample"], "total").alias("r"))


@query("empirical_p", f"SELECT sample, gene, round(count(*) OVER (PARTITION BY sample ORDER BY total DESC) / count(*) OVER (PARTITION BY sample), 6) AS p FROM {GENES}")
def empirical_p(s, d):
    return genes(s, d).select("sample", "gene", R(K.empirical_p(["sample"], "total")).alias("p"))


P = f"(SELECT sample, gene, count(*) OVER (PARTITION BY sample ORDER BY total DESC) / count(*) OVER (PARTITION BY sample) AS p FROM {GENES})"


@query("bh_fdr", f"""SELECT sample, gene, round(least(1.0, min(raw) OVER (PARTITION BY sample ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (
SELECT *, p * count(*) OVER (PARTITION BY sample) / row_number() OVER (PARTITION BY sample ORDER BY p, gene) AS raw FROM {P})""")
def bh_fdr(s, d):
    p = genes(s, d).select("sample", "gene", K.empirical_p(["sample"], "total").alias("p"))
    return K.with_q(p, ["sample"], "p", ["gene"]).select("sample", "gene", R("q").alias("q"))


@query("best_assignment", f"SELECT gene, arg_min(sample, r * 100 + i) AS sample FROM (SELECT gene, sample, dense_rank() OVER (ORDER BY sample) AS i, row_number() OVER (PARTITION BY sample ORDER BY total DESC, gene) AS r FROM {GENES}) GROUP BY 1")
def best_assignment(s, d):
    ranked = genes(s, d).withColumn("r", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("total"), "gene")))
    return ranked.groupBy("gene").agg(F.min_by("sample", F.struct("r", "sample")).alias("sample"))


@query("kth_range", f"SELECT feature, CAST(high - low AS BIGINT) AS spread FROM (SELECT feature, list_sort(list(c))[2] AS low, list_sort(list(c))[-2] AS high FROM (SELECT sample, feature, sum(count) AS c FROM {COUNTS} GROUP BY 1, 2) GROUP BY 1) WHERE high - low > 50")
def kth_range(s, d):
    c = A.counts(s, d).groupBy("sample", "feature").agg(F.sum("count").alias("c"))
    return K.kth_range(c, "feature", "c", 2).select("feature", (F.col("high") - F.col("low")).alias("spread")).filter("spread > 50")


@query("runs_min_len", f"""SELECT chrom, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - row_number() OVER (PARTITION BY chrom, value > 20 ORDER BY pos) AS run
FROM {POSITIONS}) WHERE value > 20 GROUP BY chrom, run HAVING count(*) >= 3""")
def runs_min_len(s, d):
    return U.runs(A.positions(s, d), ["chrom"], "pos", F.col("value") > 20, 3)


@query("hysteresis_calls", f"""SELECT chrom, min(pos) AS first, max(pos) AS last, count(*) AS n, max(value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - row_number() OVER (PARTITION BY chrom, value > 10 ORDER BY pos) AS run
FROM {POSITIONS}) WHERE value > 10 GROUP BY chrom, run HAVING count(*) >= 3 AND max(value) > 40""")
def hysteresis_calls(s, d):
    return U.hysteresis(A.positions(s, d), ["chrom"], "pos", "value", 10, 40, 3)


@query("rolling_upper_median", f"SELECT chrom, pos, m[len(m) // 2 + 1] AS median FROM (SELECT chrom, pos, list_sort(list(value) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS m FROM {POSITIONS})")
def rolling_upper_median(s, d):
    return A.positions(s, d).select("chrom", "pos", U.upper_median(["chrom"], "pos", "value", 3).alias("median"))


@query("rolling_mean", f"SELECT chrom, pos, round(avg(value) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 4) AS mean FROM {POSITIONS}")
def rolling_mean(s, d):
    return A.positions(s, d).select("chrom", "pos", R(F.avg("value").over(U.around(["chrom"], "pos", 5)), 4).alias("mean"))


@query("smooth_and_centre", f"WITH m AS (SELECT chrom, pos, avg(value) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS x FROM {POSITIONS}) SELECT chrom, pos, round(x - median(x) OVER (PARTITION BY chrom), 4) AS centred FROM m")
def smooth_and_centre(s, d):
    m = A.positions(s, d).select("chrom", "pos", F.avg("value").over(U.around(["chrom"], "pos", 5)).alias("x"))
    mid = m.groupBy("chrom").agg(F.median("x").alias("mid"))
    return m.join(F.broadcast(mid), "chrom").select("chrom", "pos", R(F.col("x") - F.col("mid"), 4).alias("centred"))


def _windows_sql(flush: bool, size: int = 20, stride: int = 7) -> str:
    last = f"UNION SELECT chrom, n - {size} FROM g WHERE n >= {size}" if flush else ""
    return f"""WITH p AS (SELECT chrom, value, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM {POSITIONS}), g AS (SELECT chrom, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT chrom, unnest(generate_series(0, n - {size}, {stride})) AS window_start FROM g WHERE n >= {size} {last})
SELECT w.chrom, CAST(w.window_start AS BIGINT) AS window_start, count(*) AS n, round(avg(value), 4) AS mean FROM w JOIN p ON p.chrom = w.chrom AND p.i >= w.window_start AND p.i < w.window_start + {size} GROUP BY 1, 2"""


@query("gene_windows", _windows_sql(True))
def gene_windows(s, d):
    return U.gene_windows(A.positions(s, d), "chrom", "pos", "value", 20, 7).withColumn("mean", R("mean", 4))


_SCALES = [(20, 7), (50, 10), (100, 25)]


@query("multiscale_windows", " UNION ALL ".join(f"SELECT {size} AS size, * FROM ({_windows_sql(False, size, stride)})" for size, stride in _SCALES))
def multiscale_windows(s, d):
    p = A.positions(s, d)
    return U.multiscale_windows(p, "chrom", "pos", "value", _SCALES).withColumn("mean", R("mean", 4))


@query("robust_z", f"WITH m AS (SELECT chrom, median(value) AS mid FROM {POSITIONS} GROUP BY 1), a AS (SELECT p.chrom, pos, value - mid AS dev FROM {POSITIONS} p JOIN m USING (chrom)), s AS (SELECT chrom, greatest(1.4826 * median(abs(dev)), 0.1) AS scale FROM a GROUP BY 1) SELECT chrom, pos, round(dev / scale, 6) AS z FROM a JOIN s USING (chrom)")
def robust_z(s, d):
    p = A.positions(s, d)
    dev = p.join(F.broadcast(p.groupBy("chrom").agg(F.median("value").alias("mid"))), "chrom").withColumn("dev", F.col("value") - F.col("mid"))
    scale = dev.groupBy("chrom").agg(F.greatest(F.median(F.abs("dev")) * 1.4826, F.lit(0.1)).alias("scale"))
    return dev.join(F.broadcast(scale), "chrom").select("chrom", "pos", R(F.col("dev") / F.col("scale")).alias("z"))


@query("burden_top", f"WITH r AS (SELECT gene, abs(value) AS v, row_number() OVER (PARTITION BY gene ORDER BY abs(value) DESC) AS k, count(*) OVER (PARTITION BY gene) AS n FROM {POSITIONS}) SELECT gene, round(avg(v), 6) AS burden FROM r WHERE k <= ceil(0.1 * n) GROUP BY 1")
def burden_top(s, d):
    r = A.positions(s, d).select("gene", F.abs("value").alias("v")).withColumns({"k": F.row_number().over(W.partitionBy("gene").orderBy(F.desc("v"))), "n": F.count("*").over(W.partitionBy("gene"))})
    return r.filter(F.col("k") <= F.ceil(F.col("n") * 0.1)).groupBy("gene").agg(R(F.avg("v")).alias("burden"))


@query("interval_merge", f"""WITH r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {INTERVALS}),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM k GROUP BY chrom, k""")
def interval_merge(s, d):
    return U.merged_intervals(A.intervals(s, d), "chrom", 5)


@query("coverage_consensus", f"""WITH e AS (SELECT chrom, x, sum(v) AS v FROM (SELECT chrom, start AS x, 1 AS v FROM {INTERVALS} UNION ALL SELECT chrom, "end", -1 FROM {INTERVALS}) GROUP BY 1, 2),
c AS (SELECT *, sum(v) OVER (PARTITION BY chrom ORDER BY x) >= 2 AS deep FROM e), f AS (SELECT *, coalesce(lag(deep) OVER (PARTITION BY chrom ORDER BY x), false) AS was FROM c),
g AS (SELECT chrom, x, deep, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS nxt FROM f WHERE deep != was) SELECT chrom, x AS start, nxt AS "end" FROM g WHERE deep""")
def coverage_consensus(s, d):
    return U.coverage_runs(A.intervals(s, d), "chrom", 2)


@query("genomic_sort_rank", f'SELECT id, row_number() OVER (PARTITION BY chrom ORDER BY start, "end", id) AS place FROM {INTERVALS}')
def genomic_sort_rank(s, d):
    return A.intervals(s, d).select("id", F.row_number().over(W.partitionBy("chrom").orderBy("start", "end", "id")).cast("bigint").alias("place"))


@query("stratified_cap", f"SELECT state, cell FROM (SELECT state, cell, row_number() OVER (PARTITION BY state ORDER BY md5(CAST(cell AS VARCHAR)), cell) AS k FROM {OBS}) WHERE k <= 40")
def stratified_cap(s, d):
    """A sampling operator: at most 40 cells of a state, by the order of their hash."""
    return K.top_k(A.obs(s, d).select("state", "cell"), ["state"], [F.md5(F.col("cell").cast("string").cast("binary")), F.asc("cell")], 40, "k").drop("k")


@query("set_intersection", f"SELECT gene FROM {MATRIX} WHERE value > 40 INTERSECT SELECT gene FROM {COUNTS} WHERE sample = 'AF'")
def set_intersection(s, d):
    return A.matrix(s, d).filter("value > 40").select("gene").intersect(A.counts(s, d).filter("sample = 'AF'").select("gene"))


@query("set_difference", f"SELECT DISTINCT feature FROM {COUNTS} WHERE sample = 'AF' EXCEPT SELECT feature FROM {COUNTS} WHERE sample = 'NO' AND count > 40")
def set_difference(s, d):
    c = A.counts(s, d)
    return c.filter("sample = 'AF'").select("feature").distinct().subtract(c.filter("sample = 'NO' and count > 40").select("feature"))


@query("gained_lost", f"""WITH t AS (SELECT gene, list(DISTINCT feature) FILTER (sample = 'AF') AS a, list(DISTINCT feature) FILTER (sample = 'RF') AS b FROM {COUNTS} GROUP BY 1)
SELECT gene, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS lost, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS gained, len(list_intersect(a, b)) AS shared FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def gained_lost(s, d):
    c = A.counts(s, d).groupBy("gene").agg(F.collect_set(F.when(F.col("sample") == "AF", F.col("feature"))).alias("a"), F.collect_set(F.when(F.col("sample") == "RF", F.col("feature"))).alias("b"))
    n = lambda x: F.size(x).cast("bigint")
    return c.filter("size(a) > 0 and size(b) > 0").select("gene", n(F.array_except("a", "b")).alias("lost"), n(F.array_except("b", "a")).alias("gained"), n(F.array_intersect("a", "b")).alias("shared"))


@query("jaccard_rewiring", f"""WITH t AS (SELECT gene, list(DISTINCT feature) FILTER (sample = 'AF') AS a, list(DISTINCT feature) FILTER (sample = 'RF') AS b FROM {COUNTS} GROUP BY 1)
SELECT gene, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS divergence FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def jaccard_rewiring(s, d):
    c = A.counts(s, d).groupBy("gene").agg(F.collect_set(F.when(F.col("sample") == "AF", F.col("feature"))).alias("a"), F.collect_set(F.when(F.col("sample") == "RF", F.col("feature"))).alias("b"))
    return c.filter("size(a) > 0 and size(b) > 0").select("gene", R(F.lit(1) - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("divergence"))
