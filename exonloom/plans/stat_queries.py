"""Queries on test statistics, enrichment and their tails, with oracles where SQL has the functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from exonloom.functions import special as P
from exonloom.operators import ranking as K
from exonloom.operators import stats as T
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import MATRIX, OBS

R = lambda c, n=6: F.round(c, n)
_V = f"(SELECT gene, cell, value, condition FROM {MATRIX} JOIN {OBS} USING (cell))"


def values(s, d):
    return A.matrix(s, d).join(A.obs(s, d).select("cell", "condition", "donor"), "cell")


_U = f"""(WITH r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM {_V}), t AS (SELECT gene, sum(t * t * t - t) AS ties FROM (SELECT gene, value, count(*) AS t FROM {_V} GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT gene, count(*) FILTER (condition = 'case') AS n1, count(*) FILTER (condition != 'case') AS n2, sum(r) FILTER (condition = 'case') AS s FROM r GROUP BY 1)
SELECT gene, n1, n2, s - n1 * (n1 + 1) / 2 AS u, CAST(ties AS DOUBLE) AS ties FROM u JOIN t USING (gene) WHERE n1 > 0 AND n2 > 0)"""


@query("mwu_u", f"SELECT * FROM {_U}")
def mwu_u(s, d):
    return T.mann_whitney(values(s, d), "gene", "condition", "value", "case")


@query("mwu_z", f"SELECT gene, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 6) AS z FROM {_U}")
def mwu_z(s, d):
    return T.mann_whitney_z(mwu_u(s, d)).select("gene", R("z").alias("z"))


def _simpson(f: str, low: str, high: str, panels: int = 2000) -> str:
    """SQL of the integral of f, an expression of $x, by Simpson's rule."""
    x, h = f"({low} + i * ({high} - ({low})) / {panels})", f"(({high} - ({low})) / {panels})"
    weight = f"CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"{h} / 3 * list_sum(list_transform(generate_series(0, {panels}), lambda i: {weight} * ({f.replace('$x', x)})))"


def _normal_sf(z: str) -> str:
    return f"({_simpson('exp(-$x * $x / 2)', z, f'({z}) + 12')} / sqrt(2 * pi()))"


def _with_q(p: str) -> str:
    """SQL of p's rows with Benjamini-Hochberg values."""
    ranked = f"SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM ({p})"
    return f"SELECT * EXCLUDE (raw, p), round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, gene DESC)), 6) AS q FROM ({ranked})"


_Z = f"(SELECT *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z FROM {_U})"


@query("mwu_p", f"SELECT gene, u, p, q FROM ({_with_q(f'SELECT *, least(1.0, 2 * {_normal_sf("z")}) AS p FROM {_Z}')})")
def mwu_p(s, d):
    p = P.as_udf(lambda z: min(1.0, 2 * P.normal_sf(z)))
    return K.with_q(T.mann_whitney_z(mwu_u(s, d)).withColumn("p", p("z")), [], "p", ["gene"]).select("gene", "u", R("p").alias("p"), R("q").alias("q"))


_T = f"""(WITH g AS (SELECT gene, count(*) FILTER (condition = 'case') AS n1, count(*) FILTER (condition != 'case') AS n2, avg(value) FILTER (condition = 'case') - avg(value) FILTER (condition != 'case') AS diff,
(var_samp(value) FILTER (condition = 'case') + var_samp(value) FILTER (condition != 'case')) / 2 AS s2 FROM {_V} GROUP BY 1), h AS (SELECT * FROM g WHERE n1 > 1 AND n2 > 1)
SELECT gene, n1, n2, diff, diff / sqrt((0.8 * s2 + 0.2 * (SELECT median(s2) FROM h)) * (1.0 / n1 + 1.0 / n2)) AS t, n1 + n2 - 2 AS df FROM h)"""


@query("moderated_t", f"SELECT gene, n1, n2, round(diff, 6) AS diff, round(t, 6) AS t, df FROM {_T}")
def moderated_t(s, d):
    return T.moderated_t(values(s, d), "gene", "condition", "value", "case").withColumns({"diff": R("diff"), "t": R("t")})


_DENSITY = "pow(1 + $x * $x / df, -(df + 1) / 2)"
_TP = f"1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * ({_simpson(_DENSITY, '0', 'abs(t)')})"


@query("moderated_t_p", f"SELECT gene, p, q FROM ({_with_q(f'SELECT gene, greatest(0, {_TP}) AS p FROM {_T}')})")
def moderated_t_p(s, d):
    t = T.moderated_t(values(s, d), "gene", "condition", "value", "case")
    return K.with_q(t.withColumn("p", P.as_udf(P.t_two_sided)("t", "df")), [], "p", ["gene"]).select("gene", R("p").alias("p"), R("q").alias("q"))


@query("paired_t", f"""WITH p AS (SELECT gene, donor, avg(value) FILTER (condition = 'case') - avg(value) FILTER (condition != 'case') AS d FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2),
g AS (SELECT gene, count(d) AS n, avg(d) AS mean, var_samp(d) AS s2 FROM p GROUP BY 1 HAVING count(d) > 1) SELECT gene, n, round(mean, 6) AS mean, round(mean / sqrt((4 * (SELECT median(s2) FROM g) + (n - 1) * s2) / (n + 3) / n), 6) AS t, n + 3 AS df FROM g""")
def paired_t(s, d):
    case = F.avg(F.when(F.col("condition") == "case", F.col("value"))) - F.avg(F.when(F.col("condition") != "case", F.col("value")))
    p = values(s, d).groupBy("gene", "donor").agg(case.alias("d"))
    return T.moderated_paired_t(p, "gene", "d").withColumns({"mean": R("mean"), "t": R("t")})


_MR = f"""(WITH n AS (SELECT count(*) AS n FROM {OBS}), m AS (SELECT state, count(*) AS m FROM {OBS} GROUP BY 1), a AS (SELECT gene, sum(value) AS sx, sum(value * value) AS sxx FROM {MATRIX} GROUP BY 1),
o AS (SELECT gene, state, sum(value) AS sxy FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2) SELECT gene, state, (sxy * n - sx * m) / sqrt(CAST(sxx * n - sx * sx AS DOUBLE) * (m * n - m * m)) AS r FROM o JOIN a USING (gene) JOIN m USING (state), n)"""


@query("marker_r", f"SELECT gene, state, round(r, 6) AS r FROM {_MR}")
def marker_r(s, d):
    return T.marker_r(A.matrix(s, d), A.obs(s, d)).withColumn("r", R("r"))


@query("unique_markers", f"SELECT gene, state, round(r, 6) AS r, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY r DESC, gene) AS place FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY r DESC, state) AS k FROM {_MR}) WHERE k = 1 AND r >= 0.02) WHERE place <= 10")
def unique_markers(s, d):
    best = K.top_k(T.marker_r(A.matrix(s, d), A.obs(s, d)), ["gene"], [F.desc("r"), F.asc("state")], 1, "k").filter("r >= 0.02").drop("k")
    return K.top_k(best, ["state"], [F.desc("r"), F.asc("gene")], 10).withColumn("r", R("r"))


_OV = """(WITH t AS (SELECT DISTINCT p_brand AS term, p_partkey AS gene FROM part), q AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity = 50 AND l_discount < 0.03)
SELECT term, count(*) AS k, any_value(sz) AS term_size, (SELECT count(*) FROM q) AS query_size, (SELECT count(*) FROM part) AS background FROM t JOIN q USING (gene) JOIN (SELECT term, count(*) AS sz FROM t GROUP BY 1) USING (term) GROUP BY 1)"""


def overlap(s, d):
    part = A.table(s, d, "part")
    q = A.table(s, d, "lineitem").filter("l_quantity = 50 and l_discount < 0.03").select(F.col("l_partkey").alias("gene"))
    return T.overlaps(part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")), q, part.count())


@query("enrichment_z", f"SELECT term, k, term_size, query_size, background, round((k - query_size * (term_size / background)) / sqrt(query_size * (term_size / background) * (1 - term_size / background)), 6) AS z FROM {_OV}")
def enrichment_z(s, d):
    return T.enrichment_z(overlap(s, d)).withColumn("z", R("z"))


@query("enrichment_p", f"""SELECT term, round(sum(exp(lgamma(term_size + 1) - lgamma(i + 1) - lgamma(term_size - i + 1) + lgamma(background - term_size + 1) - lgamma(query_size - i + 1) - lgamma(background - term_size - query_size + i + 1) - lgamma(background + 1) + lgamma(query_size + 1) + lgamma(background - query_size + 1))), 6) AS p
FROM (SELECT *, unnest(generate_series(k, least(term_size, query_size))) AS i FROM {_OV}) GROUP BY 1""")
def enrichment_p(s, d):
    return overlap(s, d).select("term", R(P.as_udf(P.hypergeometric_sf)("k", "background", "term_size", "query_size")).alias("p"))


_TAB = f"(SELECT gene, donor, count(*) FILTER (condition = 'case' AND value >= 30) AS a, count(*) FILTER (condition = 'case' AND value < 30) AS b, count(*) FILTER (condition != 'case' AND value >= 30) AS c, count(*) FILTER (condition != 'case' AND value < 30) AS d FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2)"


def tables(s, d):
    case, high = F.col("condition") == "case", F.col("value") >= 30
    return values(s, d).groupBy("gene", "donor").agg(F.count_if(case & high).alias("a"), F.count_if(case & ~high).alias("b"), F.count_if(~case & high).alias("c"), F.count_if(~case & ~high).alias("d"))


@query("cmh_parts", f"SELECT gene, count(*) AS strata, round(sum(a - (a + b) * (a + c) / (a + b + c + d)), 6) AS numerator, round(sum(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d) / ((a + b + c + d) * (a + b + c + d) * (a + b + c + d - 1))), 6) AS variance FROM {_TAB} WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0 GROUP BY 1 HAVING count(*) >= 2")
def cmh_parts(s, d):
    return T.cmh(tables(s, d), "gene").withColumns({"numerator": R("numerator"), "variance": R("variance")})


_CMH = f"""(SELECT gene, sum(a - (a + b) * (a + c) / (a + b + c + d)) AS n, sum(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d) / ((a + b + c + d) * (a + b + c + d) * (a + b + c + d - 1))) AS v, count(*) AS k FROM {_TAB}
WHERE a + b + c + d > 1 AND a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0 GROUP BY 1 HAVING count(*) >= 2)"""


@query("cmh_p", f"SELECT gene, k AS strata, round(least(1.0, 2 * {_normal_sf('abs(n) / sqrt(v)')}), 6) AS p FROM {_CMH}")
def cmh_p(s, d):
    p = P.as_udf(lambda n, v: P.chi2_1_sf(n * n / v) if v > 0 else 1.0)("numerator", "variance")
    return T.cmh(tables(s, d), "gene").select("gene", "strata", R(p).alias("p"))


_FISH = f"(SELECT gene, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM {_TAB} GROUP BY 1)"


@query("fisher_p", f"""SELECT gene, round(least(1.0, sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - a - c + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)))), 6) AS p
FROM (SELECT *, unnest(generate_series(greatest(a, a - d), least(a + b, a + c))) AS i FROM {_FISH}) GROUP BY 1""")
def fisher_p(s, d):
    t = tables(s, d).groupBy("gene").agg(*(F.sum(x).alias(x) for x in "abcd"))
    return t.select("gene", R(P.as_udf(P.fisher_greater)("a", "b", "c", "d")).alias("p"))


@query("binomial_p", f"""WITH t AS (SELECT gene, a, a + b AS n, CAST(c AS DOUBLE) / (c + d) AS f FROM {_FISH} WHERE c > 0 AND d > 0 AND a + b > 0) SELECT gene, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(f) + (n - i) * ln(1 - f)))), 6) AS p FROM (SELECT *, unnest(generate_series(a, n)) AS i FROM t) GROUP BY 1""")
def binomial_p(s, d):
    t = tables(s, d).groupBy("gene").agg(*(F.sum(x).alias(x) for x in "abcd")).filter("c > 0 and d > 0 and a + b > 0")
    return t.select("gene", R(P.as_udf(P.binomial_sf)("a", F.col("a") + F.col("b"), F.col("c") / (F.col("c") + F.col("d")))).alias("p"))


_LEV = f"(SELECT gene, donor, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) WHERE value > 20 GROUP BY 1, 2)"


@query("masked_corr_topk", f"SELECT x, y, n, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(abs(r), 9) DESC, y) AS k FROM (SELECT a.gene AS x, b.gene AS y, count(*) AS n, corr(a.v, b.v) AS r FROM {_LEV} a JOIN {_LEV} b USING (donor) WHERE a.gene < b.gene GROUP BY 1, 2 HAVING count(*) >= 5)) WHERE k <= 3")
def masked_corr_topk(s, d):
    v = A.matrix(s, d).filter("value > 20").join(A.obs(s, d), "cell").groupBy("gene", "donor").agg(F.avg("value").alias("v"))
    return T.correlated_pairs(v, "gene", "donor", "v", 5, top=3).select("x", "y", "n", R("r").alias("r"))


@query("tfidf_cluster", f"""WITH k AS (SELECT state, gene, count(*) AS k FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2), m AS (SELECT state, count(*) AS m FROM {OBS} GROUP BY 1)
SELECT state, gene, round((k / m + 1e-5) * -log10(sum(k) OVER (PARTITION BY gene) / (SELECT count(*) FROM {OBS}) + 1e-5), 6) AS score FROM k JOIN m USING (state)""")
def tfidf_cluster(s, d):
    return T.tf_idf(A.matrix(s, d), A.obs(s, d)).withColumn("score", R("score"))


@query("dispersion_hvg", f"SELECT gene, round((sum(value * value) / (SELECT count(*) FROM {OBS}) - (sum(value) / (SELECT count(*) FROM {OBS})) ** 2) / (sum(value) / (SELECT count(*) FROM {OBS})), 4) AS dispersion FROM {MATRIX} GROUP BY 1 HAVING count(DISTINCT value) > 5")
def dispersion_hvg(s, d):
    n = F.lit(A.obs(s, d).count())
    mean = F.sum("value") / n
    g = A.matrix(s, d).groupBy("gene").agg(R((F.sum(F.col("value") * F.col("value")) / n - mean * mean) / mean, 4).alias("dispersion"), F.count_distinct("value").alias("_k"))
    return g.filter("_k > 5").drop("_k")


@query("log2_fold_change", f"SELECT gene, round(log2((avg(value) FILTER (condition = 'case') + 1) / (avg(value) FILTER (condition != 'case') + 1)), 6) AS log2fc FROM {_V} GROUP BY 1")
def log2_fold_change(s, d):
    case = F.col("condition") == "case"
    mean = lambda c: F.avg(F.when(c, F.col("value"))) + 1
    return values(s, d).groupBy("gene").agg(R(F.log2(mean(case) / mean(~case))).alias("log2fc"))


@query("size_residual", f"SELECT gene, round(n - (regr_slope(n, m) OVER () * m + regr_intercept(n, m) OVER ()), 4) AS residual FROM (SELECT gene, count(*) AS n, sum(value) AS m FROM {MATRIX} GROUP BY 1)")
def size_residual(s, d):
    g = A.matrix(s, d).groupBy("gene").agg(F.count("*").alias("n"), F.sum("value").alias("m"))
    fit = g.agg(F.regr_slope("n", "m").alias("b"), F.regr_intercept("n", "m").alias("a"))
    return g.crossJoin(F.broadcast(fit)).select("gene", R(F.col("n") - (F.col("b") * F.col("m") + F.col("a")), 4).alias("residual"))


@query("row_median_imputation", f"WITH w AS (SELECT gene, donor, CASE WHEN v < 28 THEN v END AS v FROM {_LEV}) SELECT gene, donor, round(coalesce(v, median(v) OVER (PARTITION BY gene)), 6) AS v FROM w")
def row_median_imputation(s, d):
    v = A.matrix(s, d).filter("value > 20").join(A.obs(s, d), "cell").groupBy("gene", "donor").agg(F.avg("value").alias("v")).withColumn("v", F.when(F.col("v") < 28, F.col("v")))
    mid = v.groupBy("gene").agg(F.median("v").alias("m"))
    return v.join(mid, "gene").select("gene", "donor", R(F.coalesce("v", "m")).alias("v"))


@query("elo_rating", f"SELECT donor, round(avg(share), 6) AS rating FROM (SELECT donor, state, avg(value) / 5 AS share FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2) GROUP BY 1")
def elo_rating(s, d):
    per = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("donor", "state").agg((F.avg("value") / 5).alias("share"))
    return per.groupBy("donor").agg(R(F.avg("share")).alias("rating"))


@query("auroc", f"WITH r AS (SELECT gene, condition, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM {_V}) SELECT gene, round((sum(r) FILTER (condition = 'case') - count(*) FILTER (condition = 'case') * (count(*) FILTER (condition = 'case') + 1) / 2) / (count(*) FILTER (condition = 'case') * count(*) FILTER (condition != 'case')), 6) AS auroc FROM r GROUP BY 1")
def auroc(s, d):
    return mwu_u(s, d).select("gene", R(F.col("u") / (F.col("n1") * F.col("n2"))).alias("auroc"))


@query("pattern_coding", f"SELECT gene, string_agg(CASE WHEN m > g THEN '+' ELSE '-' END, '' ORDER BY state) AS pattern FROM (SELECT gene, state, avg(value) AS m FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2) JOIN (SELECT gene, avg(value) AS g FROM {MATRIX} GROUP BY 1) USING (gene) GROUP BY 1")
def pattern_coding(s, d):
    m = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "state").agg(F.avg("value").alias("m"))
    g = A.matrix(s, d).groupBy("gene").agg(F.avg("value").alias("g"))
    signs = m.join(g, "gene").groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("state", F.when(F.col("m") > F.col("g"), "+").otherwise("-").alias("x")))).alias("a"))
    return signs.select("gene", F.array_join(F.transform("a", lambda a: a["x"]), "").alias("pattern"))
