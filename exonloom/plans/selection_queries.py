"""Queries on what is kept, drawn, ranked or re-keyed, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import ranking as K
from exonloom.operators import selection as S
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import MATRIX, OBS

R = lambda c, n=6: F.round(c, n)
#: The SQL of selection.drawn() for a key.
_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_BOOT = f"""(WITH c AS (SELECT state, cell, row_number() OVER (PARTITION BY state ORDER BY cell) - 1 AS place, count(*) OVER (PARTITION BY state) AS n FROM {OBS}),
d AS (SELECT state, n, r, i FROM (SELECT DISTINCT state, n FROM c WHERE n >= 20), generate_series(0, 19) a(r), generate_series(0, 9) b(i)),
p AS (SELECT state, r AS replicate, {_DRAW.format("state || ':' || r || ':' || i")} % n AS place, count(*) AS times FROM d GROUP BY ALL)
SELECT p.state, p.replicate, c.cell, p.times FROM p JOIN c ON c.state = p.state AND c.place = p.place)"""


def boot(s, d):
    return S.bootstrap_groups(A.obs(s, d), "state", 20, 10, 20)


@query("bootstrap_metacells", f"SELECT state, replicate, gene, CAST(sum(value * times) AS BIGINT) AS total FROM {MATRIX} JOIN {_BOOT} USING (cell) GROUP BY 1, 2, 3")
def bootstrap_metacells(s, d):
    return S.grouped_sum(A.matrix(s, d), boot(s, d), ["state", "replicate"])


@query("bootstrap_log2cp10k", f"""WITH b AS (SELECT state, replicate, gene, sum(value * times) AS total FROM {MATRIX} JOIN {_BOOT} USING (cell) GROUP BY 1, 2, 3)
SELECT state, replicate, gene, round(log2(total / sum(total) OVER (PARTITION BY state, replicate) * 10000 + 1), 6) AS level FROM b""")
def bootstrap_log2cp10k(s, d):
    b = bootstrap_metacells(s, d)
    whole = b.groupBy("state", "replicate").agg(F.sum("total").alias("whole"))
    return b.join(whole, ["state", "replicate"]).select("state", "replicate", "gene", R(F.log2(F.col("total") / F.col("whole") * 10000 + 1)).alias("level"))


@query("random_metacells", f"""SELECT "group", count(*) AS cells, min(cell) AS first FROM (SELECT cell, (row_number() OVER (ORDER BY md5('7:' || cell), cell) - 1) // 25 AS "group" FROM {OBS}) GROUP BY 1""")
def random_metacells(s, d):
    return S.random_groups(A.obs(s, d), 25, 7).groupBy("group").agg(F.count("*").alias("cells"), F.min("cell").alias("first"))


_MOL = "(SELECT l_returnflag AS source, l_partkey AS molecule, l_suppkey AS cell, CAST(l_quantity AS BIGINT) AS count FROM lineitem)"


def molecules(s, d):
    return A.table(s, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("molecule"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("count"))


@query("consensus_isoforms", f"""SELECT cell, p_brand || '/' || source AS isoform, CAST(sum(count) AS BIGINT) AS count FROM {_MOL} JOIN part ON p_partkey = molecule WHERE source IN ('A', 'R') GROUP BY 1, 2""")
def consensus_isoforms(s, d):
    part = A.table(s, d, "part").select(F.col("p_partkey").alias("molecule"), F.explode(F.array(F.lit("A"), F.lit("R"))).alias("source"), "p_brand")
    return S.consensus(molecules(s, d), part.select("source", "molecule", F.concat("p_brand", F.lit("/"), "source").alias("isoform")))


@query("isoform_rekey", f"""SELECT cell, target, round(sum(count * weight), 6) AS count FROM {_MOL} JOIN (SELECT p_partkey AS molecule, p_partkey % 50 AS target, CAST(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS weight FROM part
UNION ALL SELECT p_partkey, p_partkey % 50 + 1000, 0.25 FROM part WHERE p_size <= 25) USING (molecule) GROUP BY 1, 2""")
def isoform_rekey(s, d):
    k, hard = F.col("p_partkey"), F.col("p_size") > 25
    ways = F.array(F.struct((k % 50).alias("target"), F.when(hard, 1.0).otherwise(0.75).alias("weight")), F.struct((k % 50 + 1000).alias("target"), F.when(~hard, 0.25).alias("weight")))
    w = A.table(s, d, "part").select(k.alias("source"), F.explode(ways).alias("w")).select("source", "w.target", "w.weight").filter("weight is not null")
    counts = molecules(s, d).select("cell", F.col("molecule").alias("source"), "count")
    return S.rekeyed(counts, w).withColumn("count", R("count"))


@query("merged_runs", f"SELECT cell, molecule, CAST(sum(count) AS BIGINT) AS count FROM {_MOL} GROUP BY 1, 2")
def merged_runs(s, d):
    m = molecules(s, d)
    return S.merged_runs([m.filter(F.col("source") == x) for x in "ARN"], ["cell", "molecule"], "count")


@query("isoform_outliers", f"""SELECT molecule, total, known FROM (SELECT molecule, count(*) AS total, molecule % 4 = 0 AS known FROM {_MOL} WHERE cell % 7 = 0 GROUP BY 1) WHERE CASE WHEN known THEN total > 0 ELSE total >= 3 END""")
def isoform_outliers(s, d):
    t = molecules(s, d).filter("cell % 7 = 0").groupBy("molecule").agg(F.count("*").alias("total")).withColumn("known", F.col("molecule") % 4 == 0)
    return S.without_outliers(t, "total", "known")


def barcodes(s, d):
    nt = F.substring(F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 16)
    c = A.table(s, d, "customer").select(F.concat(nt, F.lit("-1")).alias("barcode"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("ord"))
    turned = F.concat(F.reverse(F.translate(F.substring("barcode", 1, 16), "ACGT", "TGCA")), F.lit("-1"))
    return c.filter("ord % 3 > 0").select("barcode", "ord"), c.select(F.when(F.col("ord") % 4 > 0, turned).otherwise(F.col("barcode")).alias("barcode"), "label", "ord")


_BC = "(SELECT substr(translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) || '-1' AS barcode, c_mktsegment AS label, c_custkey AS ord FROM customer)"
_LB = f"(SELECT CASE WHEN ord % 4 > 0 THEN reverse(translate(substr(barcode, 1, 16), 'ACGT', 'TGCA')) || '-1' ELSE barcode END AS barcode, label, ord FROM {_BC})"
_MATCH = f"""SELECT 'forward' AS orientation, count(*) FILTER (barcode IN (SELECT barcode FROM {_BC} WHERE ord % 3 > 0)) AS matched, count(*) AS labelled FROM (SELECT DISTINCT barcode FROM {_LB})
UNION ALL SELECT 'reverse', count(*) FILTER ((reverse(translate(substr(barcode, 1, 16), 'ACGT', 'TGCA')) || '-1') IN (SELECT barcode FROM {_BC} WHERE ord % 3 > 0)), count(*) FROM (SELECT DISTINCT barcode FROM {_LB})"""


@query("barcode_match", f"SELECT *, round(matched * 100 / labelled, 6) AS percent FROM ({_MATCH})")
def barcode_match(s, d):
    return S.matched_barcodes(*barcodes(s, d)).withColumn("percent", R("percent"))


@query("barcode_labels", f"""SELECT c.barcode, c.ord, l.label FROM {_BC} c JOIN {_LB} l ON c.barcode = reverse(translate(substr(l.barcode, 1, 16), 'ACGT', 'TGCA')) || '-1' WHERE c.ord % 3 > 0""")
def barcode_labels(s, d):
    return S.joined_barcodes(*barcodes(s, d))


_META = """(SELECT c_custkey AS sample, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 2 AS VARCHAR) END AS smoker, CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE c_mktsegment END AS tissue FROM customer)"""


@query("covariates_one_hot", f"""SELECT sample, 'smoker' AS covariate, CASE WHEN smoker != '' THEN CAST(smoker AS DOUBLE) END AS value FROM {_META} UNION ALL
SELECT sample, 'tissue=' || level, CASE WHEN tissue != 'NA' THEN CAST(tissue = level AS DOUBLE) END FROM {_META}, (SELECT DISTINCT tissue AS level FROM {_META} WHERE tissue != 'NA')""")
def covariates_one_hot(s, d):
    k = F.col("c_custkey")
    meta = A.table(s, d, "customer").select(k.alias("sample"), F.when(k % 5 == 0, "").otherwise((k % 2).cast("string")).alias("smoker"), F.when(k % 7 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("tissue"))
    return S.one_hot(meta, "sample", ["smoker", "tissue"], ["", "NA"])


@query("group_checks", f"""SELECT 'two' AS case, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM {OBS} GROUP BY condition)) < 6 THEN 3 ELSE 4 END AS code UNION ALL SELECT 'many', 2
UNION ALL SELECT 'one', 1 UNION ALL SELECT 'odd', 0""")
def group_checks(s, d):
    obs = A.obs(s, d).select(F.col("cell").alias("sample"), F.col("condition").alias("grp"), "state")
    many, one = obs.select("sample", F.col("state").alias("grp")), obs.filter("grp = 'case'")
    cases = {"two": (obs, obs), "many": (many, many), "one": (one, one), "odd": (one, obs)}
    out = [S.group_check(g, x, 6).select(F.lit(k).alias("case"), "code") for k, (g, x) in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_LEV = f"(SELECT gene, donor, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) WHERE value > 20 AND gene % 4 = 0 GROUP BY 1, 2)"


def levels(s, d):
    m = A.matrix(s, d).filter("value > 20 and gene % 4 = 0").join(A.obs(s, d), "cell")
    return m.groupBy("gene", "donor").agg(F.avg("value").alias("v"))


_ALL_LEV = f"(SELECT gene, donor, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2)"


def all_levels(s, d):
    return A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor").agg(F.avg("value").alias("v"))


@query("intercorrelated_features", f"""SELECT gene, count(*) + 1 AS partners FROM (SELECT a.gene, b.gene AS other, corr(a.v, b.v) AS r FROM {_ALL_LEV} a JOIN {_ALL_LEV} b USING (donor) WHERE a.gene != b.gene GROUP BY 1, 2 HAVING count(*) >= 3)
WHERE r > 0.1 GROUP BY 1 HAVING count(*) + 1 > 3""")
def intercorrelated_features(s, d):
    return S.with_partners(all_levels(s, d), "gene", "donor", "v", 0.1, 3)


@query("weighted_corr", f"""WITH w AS (SELECT donor AS sample, count(*) AS w FROM {_LEV} GROUP BY 1), t AS (SELECT l.gene, c, w.w, l.v AS x, CASE WHEN c = 0 THEN n_regionkey + n_nationkey / 10.0 ELSE n_nationkey % 7 END AS y
FROM {_LEV} l JOIN nation ON n_nationkey = donor JOIN w ON w.sample = donor, (VALUES (0), (1)) k(c)),
s AS (SELECT gene, c, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * y * y) AS wyy, sum(w * x * y) AS wxy FROM t GROUP BY 1, 2)
SELECT gene, c AS component, round((wxy / w - wx * wy / (w * w)) / sqrt((wxx / w - wx * wx / (w * w)) * (wyy / w - wy * wy / (w * w))), 6) AS r FROM s
WHERE (wxx / w - wx * wx / (w * w)) * (wyy / w - wy * wy / (w * w)) > 1e-12""")
def weighted_corr(s, d):
    v = levels(s, d).select("gene", F.col("donor").alias("sample"), F.col("v").alias("value"))
    k = F.col("n_nationkey")
    two = F.array(F.struct(F.lit(0).alias("component"), (F.col("n_regionkey") + k / 10).alias("level")), F.struct(F.lit(1).alias("component"), (k % 7).cast("double").alias("level")))
    profile = A.table(s, d, "nation").select(k.alias("sample"), F.explode(two).alias("p")).select("sample", "p.component", "p.level")
    weights = v.groupBy("sample").agg(F.count("*").alias("weight"))
    return S.weighted_correlation(v, profile, weights, "gene").withColumn("r", R("r"))


@query("input_scaling", f"""SELECT 'counts' AS input, 'counts' AS status, count(DISTINCT cell) AS cells FROM {MATRIX} UNION ALL SELECT 'cp10k', 'linear_normalized', count(DISTINCT cell) FROM {MATRIX}
UNION ALL SELECT 'log1p', 'ok', count(DISTINCT cell) FROM {MATRIX} UNION ALL SELECT 'log2', 'ok', count(DISTINCT cell) FROM {MATRIX} UNION ALL SELECT 'centred', 'prescaled', count(DISTINCT cell) FROM {MATRIX}
UNION ALL SELECT 'sqrt', 'unknown', count(DISTINCT cell) FROM {MATRIX}""")
def input_scaling(s, d):
    m = A.matrix(s, d)
    total = m.groupBy("cell").agg(F.sum("value").alias("t"))
    level = m.join(total, "cell").withColumn("value", F.col("value") / F.col("t") * 10000).drop("t")
    of = lambda df, c: df.withColumn("value", c)
    v = F.col("value")
    inputs = {"counts": m, "cp10k": level, "log1p": of(level, F.log1p(v)), "log2": of(level, F.log2(v + 1)), "centred": of(m, v - 20.5), "sqrt": of(m, F.sqrt(v.cast("double")) * 0.37)}
    out = [S.scaling_status(x, None, 0).select(F.lit(k).alias("input"), "status", "cells") for k, x in inputs.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query("median_scaled_log2", f"""WITH t AS (SELECT cell, sum(value) AS t FROM {MATRIX} GROUP BY 1) SELECT cell, gene, round(log2(value / t * (SELECT median(t) FROM t) + 1), 6) AS value FROM {MATRIX} JOIN t USING (cell)""")
def median_scaled_log2(s, d):
    return S.median_scaled(A.matrix(s, d)).withColumn("value", R("value"))


_P = "(SELECT l_orderkey, l_linenumber, l_partkey, floor(l_partkey * CAST(l_quantity AS BIGINT) / 200) / 10000 AS p FROM lineitem)"


@query("shortlisted_q", f"""WITH a AS (SELECT p, count(*) AS n FROM {_P} GROUP BY 1), r AS (SELECT p, p * sum(n) OVER () / sum(n) OVER (ORDER BY p) AS raw FROM a), q AS (SELECT p, least(1.0, min(raw) OVER (ORDER BY p DESC)) AS q FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, p, round(q, 6) AS q FROM {_P} JOIN q USING (p) WHERE p < 0.0005""")
def shortlisted_q(s, d):
    p = F.floor(F.col("l_partkey") * F.col("l_quantity").cast("bigint") / 200) / 10000
    t = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p"))
    return K.q_of_all(t, t.filter("p < 0.0005")).withColumn("q", R("q"))
