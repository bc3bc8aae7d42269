"""Queries on fitted models; SQL has no equal for most, tests hold them against their defining equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import counting as C
from exonloom.operators import models as M
from exonloom.plans.registry import query
from exonloom.sources import adapters as A

R = lambda c, n=6: F.round(c, n)


@query("ridge_fit", """WITH m AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem) SELECT 'l_quantity' AS feature, round((sxy - sx * sy / n) / (sxx - sx * sx / n + 10.0), 4) AS weight FROM m""")
def ridge_fit(s, d):
    w, _ = M.ridge_normal(A.table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)
    return s.createDataFrame([("l_quantity", float(w[0]))], "feature string, weight double").withColumn("weight", R("weight", 4))


def donor_levels(s, d):
    return A.matrix(s, d).join(A.obs(s, d), "cell").groupBy(F.col("donor").alias("sample"), "gene").agg(F.avg("value").alias("value"))


@query("elastic_net_targets")
def elastic_net_targets(s, d):
    y = A.obs(s, d).groupBy(F.col("donor").alias("sample"), F.col("state").alias("target")).agg(F.count("*").alias("y"))
    return M.per_target_elastic_net(donor_levels(s, d), y, 0.1, 0.5)


@query("nnls_fractions")
def nnls_fractions(s, d):
    return M.deconvolved(donor_levels(s, d), C.mean_and_detection(A.matrix(s, d), A.obs(s, d)).select("state", "gene", "mean"))


@query("cox_regression")
def cox_regression(s, d):
    o = A.table(s, d, "orders")
    return M.cox(o.select("o_orderpriority", F.col("o_custkey").alias("time"), (F.col("o_orderstatus") == "F").alias("event"), (F.col("o_totalprice") / 1e5).alias("x")), "o_orderpriority")


@query("gsea_preranked")
def gsea_preranked(s, d):
    scores = A.table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score"))
    terms = A.table(s, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    return M.gsea(scores, terms, 50)


@query("communities")
def communities(s, d):
    o = A.table(s, d, "orders")
    x, y = F.col("o_custkey"), F.col("o_orderkey")
    edges = o.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))
    return M.communities(edges)
