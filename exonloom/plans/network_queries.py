"""Queries on communication, networks, copy states, models, graphs and collapse, with oracles where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import counting as C
from exonloom.operators import graphs as G
from exonloom.operators import networks as N
from exonloom.operators import structures as S
from exonloom.plans.registry import query
from exonloom.plans.token_queries import _S, structures
from exonloom.sources import adapters as A
from exonloom.sources.adapters import MATRIX, OBS, POSITIONS
from exonloom.sources.shared import merged

R = lambda c, n=6: F.round(c, n)
_ST = f"(SELECT state, gene, sum(value) / any_value(n) AS mean, count(*) / any_value(n) AS det FROM {MATRIX} JOIN {OBS} USING (cell) JOIN (SELECT state, count(*) AS n FROM {OBS} GROUP BY 1) USING (state) GROUP BY 1, 2)"


@query("lr_score", f"""WITH s AS (SELECT *, CASE WHEN sum(mean) OVER (PARTITION BY gene) > 0 THEN mean / sum(mean) OVER (PARTITION BY gene) ELSE 0 END AS spec FROM {_ST}), t AS (SELECT * FROM s WHERE mean > 5),
p AS (SELECT s_suppkey AS ligand, s_suppkey // 2 AS receptor, CASE WHEN s_nationkey < 12 THEN 1.0 ELSE 0.9 END AS weight FROM supplier)
SELECT ligand, receptor, l.state AS sender, r.state AS receiver, round(ln(1 + l.mean) * ln(1 + r.mean) * (0.5 + 0.5 * least(l.det, r.det)) * (0.5 + 0.5 * sqrt(l.spec * r.spec)) * weight, 6) AS score FROM p JOIN t l ON l.gene = ligand JOIN t r ON r.gene = receptor""")
def lr_score(s, d):
    pairs = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("ligand"), F.expr("s_suppkey div 2").alias("receptor"), F.when(F.col("s_nationkey") < 12, 1.0).otherwise(0.9).alias("weight"))
    return N.ligand_receptor(C.mean_and_detection(A.matrix(s, d), A.obs(s, d)), pairs, 5).withColumn("score", R("score"))


@query("ambient_subtract", f"""WITH m AS (SELECT * FROM {MATRIX}), t AS (SELECT cell, sum(value) AS t FROM m GROUP BY 1), c AS (SELECT quantile_cont(t, 0.1) AS cut FROM t), p AS (SELECT gene, sum(value) AS g FROM m WHERE cell IN (SELECT cell FROM t, c WHERE t <= cut) GROUP BY 1),
q AS (SELECT gene, g / (SELECT sum(g) FROM p) AS soup FROM p) SELECT cell, gene, round(value - 0.3 * t * coalesce(soup, 0), 6) AS value FROM m JOIN t USING (cell) LEFT JOIN q USING (gene) WHERE value - 0.3 * t * coalesce(soup, 0) > 0""")
def ambient_subtract(s, d):
    m = A.matrix(s, d)
    return N.without_ambient(m, N.ambient_profile(m, 0.1), 0.3).withColumn("value", R("value"))


@query("edge_activity", f"""WITH l AS (SELECT gene, donor, avg(value) - 20 AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2) SELECT s_suppkey AS source, s_suppkey // 3 AS target, a.donor, round((s_nationkey + 1) * sqrt(greatest(a.v, 0) * greatest(b.v, 0)), 6) AS activity
FROM supplier JOIN l a ON a.gene = s_suppkey JOIN l b ON b.gene = s_suppkey // 3 AND b.donor = a.donor""")
def edge_activity(s, d):
    levels = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor").agg((F.avg("value") - 20).alias("value"))
    edges = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("source"), F.expr("s_suppkey div 3").alias("target"), (F.col("s_nationkey") + 1).alias("weight"))
    return N.edge_activity(edges, levels, ["donor"]).withColumn("activity", R("activity"))


@query("fold_matrix", f"""WITH l AS (SELECT gene, donor, condition, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2, 3), b AS (SELECT gene, avg(v) AS b FROM l WHERE condition = 'control' GROUP BY 1)
SELECT gene, donor, round(v - b - min(v - b) OVER (PARTITION BY gene), 6) AS fold FROM l JOIN b USING (gene) WHERE condition != 'control'""")
def fold_matrix(s, d):
    levels = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor", "condition").agg(F.avg("value").alias("v"))
    return N.fold_matrix(levels, "gene", "donor", "v", "control").withColumn("fold", R("fold"))


@query("copy_state", f"""WITH w AS (SELECT gene, chrom, avg(value) / 20 AS x FROM {POSITIONS} GROUP BY 1, 2), s AS (SELECT gene, chrom, x, c, -((x - c) * (x - c)) / (2 * 0.25 * 0.25) AS ll FROM w, (VALUES (0.5), (1.0), (1.5), (2.0)) v(c))
SELECT gene, chrom, CAST(arg_min(c, -ll) AS DOUBLE) AS copies, round(2 * (max(ll) + max((x - 1) * (x - 1)) / (2 * 0.25 * 0.25)), 6) AS lead FROM s GROUP BY 1, 2""")
def copy_state(s, d):
    v = A.positions(s, d).groupBy("gene", "chrom").agg((F.avg("value") / 20).alias("x"))
    return N.copy_state(v, ["gene", "chrom"], "x", [0.5, 1.0, 1.5, 2.0], 0.25).withColumn("lead", R("lead"))


@query("apply_weights", f"""WITH l AS (SELECT gene, donor, avg(value) / 10000 AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2) SELECT donor, s_nationkey AS target, round(greatest(0, least(1, sum(v * (s_acctbal / 1000)) + 0.1)), 6) AS value FROM supplier JOIN l ON l.gene = s_suppkey GROUP BY 1, 2""")
def apply_weights(s, d):
    levels = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor").agg((F.avg("value") / 10000).alias("value"))
    weights = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("target"), (F.col("s_acctbal") / 1000).alias("weight"))
    shift = A.table(s, d, "nation").select(F.col("n_nationkey").alias("target"), F.lit(0.1).alias("intercept"))
    return N.applied_weights(levels, weights, shift, "donor").withColumn("value", R("value"))


@query("network_extract", "SELECT s_suppkey AS source, s_suppkey // 3 AS target FROM supplier WHERE s_suppkey != s_suppkey // 3 AND s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) AND s_suppkey // 3 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def network_extract(s, d):
    sup = A.table(s, d, "supplier")
    edges = sup.select(F.col("s_suppkey").alias("source"), F.expr("s_suppkey div 3").alias("target"))
    return N.network_extract(edges, sup.filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("gene")))


@query("dag_closure", "WITH RECURSIVE c AS (SELECT p_partkey // 3 AS ancestor, p_partkey AS descendant, 1 AS depth FROM part WHERE p_partkey > 0 UNION ALL SELECT c.ancestor // 3, c.descendant, c.depth + 1 FROM c WHERE c.ancestor > 0) SELECT * FROM c")
def dag_closure(s, d):
    return G.closure(A.table(s, d, "part").filter("p_partkey > 0").select(F.expr("p_partkey div 3").alias("parent"), F.col("p_partkey").alias("child")))


@query("pagerank")
def pagerank(s, d):
    return G.pagerank(A.table(s, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 3").alias("target")))


def _fold_sql(rows: str) -> str:
    """SQL of the containment fold of (gene, structure, reads, is_ref)."""
    return f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY is_ref DESC, len(string_split(structure, '|')) DESC, reads DESC, structure) AS k FROM {rows}),
p AS (SELECT a.gene, a.structure, b.structure AS parent, b.k FROM n a JOIN n b ON a.gene = b.gene AND b.k < a.k AND NOT a.is_ref AND contains('|' || b.structure || '|', '|' || a.structure || '|')),
r AS (SELECT p.gene, p.structure, arg_min(p.parent, p.k) AS parent FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.gene = p.gene AND q.structure = p.parent) GROUP BY 1, 2)
SELECT n.gene, n.structure, n.reads, n.is_ref, coalesce(r.parent, n.structure) AS parent FROM n LEFT JOIN r ON r.gene = n.gene AND r.structure = n.structure"""


@query("collapse_core", _fold_sql(f"(SELECT gene, array_to_string(t, '|') AS structure, CAST(len(t) AS BIGINT) AS reads, gene % 5 = 0 AS is_ref FROM {_S})"))
def collapse_core(s, d):
    t = structures(s, d).select("gene", F.array_join("t", "|").alias("structure"), F.size("t").cast("bigint").alias("reads"), (F.col("gene") % 5 == 0).alias("is_ref"))
    return S.collapse(t)


_CS = f"""(SELECT c_nationkey AS gene, array_to_string(t, '|') AS structure, CAST(sum(len(t)) AS BIGINT) AS reads, bool_or(s.gene % 50 = 0) AS is_ref
FROM {_S} s JOIN customer ON c_custkey = s.gene GROUP BY 1, 2)"""


def by_nation(s, d):
    t = structures(s, d).join(merged(A.table(s, d, "customer").select(F.col("c_custkey").alias("gene"), "c_nationkey")), "gene")
    return t.select(F.col("c_nationkey").alias("gene"), F.array_join("t", "|").alias("structure"), F.size("t").cast("bigint").alias("reads"), (F.col("gene") % 50 == 0).alias("is_ref"))


@query("containment_fold", _fold_sql(_CS))
def containment_fold(s, d):
    return S.collapse(by_nation(s, d))


_JC = f"""(WITH w AS (SELECT * FROM (SELECT *, string_split(structure, '|') AS whole FROM {_CS}) WHERE reads >= 2 OR is_ref),
o AS (SELECT *, list_filter(whole, lambda x, i: i = 1 OR x != whole[i - 1]) AS t FROM w),
b AS (SELECT *, list_transform(t, lambda x: split_part(x, '.', 1)) AS bl FROM o),
e AS (SELECT *, coalesce(list_max(list_filter(generate_series(1, len(t)), lambda i: len(list_distinct(bl[1:i])) = 1)), 1) AS f, coalesce(list_min(list_filter(generate_series(1, len(t)), lambda i: len(list_distinct(bl[i:])) = 1)), 1) AS l FROM b),
c AS (SELECT gene, structure, reads, is_ref, '|' || array_to_string(CASE WHEN len(list_distinct(bl)) < 2 THEN whole ELSE t[f:l] END, '|') || '|' AS core, len(whole) AS flen FROM e)
SELECT *, len(core) - len(replace(core, '|', '')) - 1 AS n FROM c)"""


@query("core_collapse", f"""WITH c AS {_JC}, er AS (SELECT * FROM c WHERE is_ref), es AS (SELECT * FROM er a WHERE NOT EXISTS (SELECT 1 FROM er b WHERE b.gene = a.gene AND b.n > a.n AND contains(b.core, a.core))),
ep AS (SELECT a.gene, a.structure, first(b.structure ORDER BY b.flen DESC, b.structure DESC) AS parent FROM er a JOIN es b ON a.gene = b.gene AND b.n > a.n AND contains(b.core, a.core) GROUP BY 1, 2),
np AS (SELECT a.gene, a.structure, first(b.structure ORDER BY b.flen DESC, b.structure) AS parent FROM c a JOIN es b ON a.gene = b.gene AND NOT a.is_ref AND contains(b.core, a.core) GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, reads DESC, structure) AS k FROM c WHERE NOT is_ref AND (gene, structure) NOT IN (SELECT (gene, structure) FROM np)),
mr AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.gene = a.gene AND b.k < a.k AND contains(b.core, a.core))),
mp AS (SELECT a.gene, a.structure, arg_min(b.structure, b.k) AS parent FROM m a JOIN mr b ON a.gene = b.gene AND b.k < a.k AND contains(b.core, a.core) GROUP BY 1, 2)
SELECT c.gene, c.structure, c.reads, c.is_ref, coalesce(ep.parent, np.parent, mp.parent, c.structure) AS parent FROM c LEFT JOIN ep USING (gene, structure) LEFT JOIN np USING (gene, structure) LEFT JOIN mp USING (gene, structure)""")
def core_collapse(s, d):
    return S.collapse_by_core(by_nation(s, d), 2)


@query("substring_collapse", f"""SELECT gene, structure, coalesce((SELECT first(b.structure ORDER BY length(b.structure) DESC, b.structure) FROM {_CS} b WHERE b.gene = a.gene AND length(b.structure) > length(a.structure)
AND contains('|' || b.structure || '|', '|' || a.structure || '|')), structure) AS parent FROM {_CS} a""")
def substring_collapse(s, d):
    return S.longest_container(by_nation(s, d))
