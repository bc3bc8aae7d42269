"""Queries on reads, genotypes, tumour specificity and arms, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import reads as E
from exonloom.operators import tumour as T
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import COUNTS, MATRIX, OBS, POSITIONS

R = lambda c, n=6: F.round(c, n)


def reads(s, d):
    """Lines as reads: an aligned block as long as the quantity, a gap as long as the part's number, another block."""
    q, p = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 300 + 1
    return A.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), F.col("l_returnflag").alias("chrom"), (F.col("l_orderkey") % 5000).alias("pos"),
        F.concat(q.cast("string"), F.lit("M"), p.cast("string"), F.lit("N"), (q + 5).cast("string"), F.lit("M")).alias("cigar"), (F.col("l_suppkey") % 4096).cast("int").alias("flag"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
    )


_R = "(SELECT l_orderkey * 10 + l_linenumber AS read, l_returnflag AS chrom, l_orderkey % 5000 AS pos, CAST(l_quantity AS BIGINT) AS q, l_partkey % 300 + 1 AS n, l_suppkey % 4096 AS flag, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem)"


@query("read_filter", f"SELECT flag, count(*) AS n FROM {_R} WHERE flag & (4 + 256 + 1024 + 2048) = 0 AND NOT (flag & 1 = 1 AND (flag & 8 = 8 OR flag & 2 = 0)) GROUP BY 1")
def read_filter(s, d):
    return reads(s, d).filter(E.usable(F.col("flag"))).groupBy(F.col("flag").cast("bigint").alias("flag")).agg(F.count("*").alias("n"))


@query("junction_counting", f'SELECT chrom, pos + q AS start, pos + q + n AS "end", strand, count(*) AS count FROM {_R} GROUP BY ALL')
def junction_counting(s, d):
    return E.junction_counts(reads(s, d))


@query("junction_counting_unstranded", f"SELECT chrom, pos + q AS start, pos + q + n AS \"end\", '.' AS strand, count(*) AS count FROM {_R} GROUP BY ALL")
def junction_counting_unstranded(s, d):
    return E.junction_counts(reads(s, d), stranded=False)


_I = "(SELECT s_suppkey AS intron, CASE s_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, s_suppkey * 37 % 5000 AS start, s_suppkey * 37 % 5000 + 60 AS e FROM supplier)"
_IC = f"""(WITH b AS (SELECT read, chrom, pos AS a, pos + q AS z FROM {_R} UNION ALL SELECT read, chrom, pos + q + n, pos + q + n + q + 5 FROM {_R}),
h AS (SELECT DISTINCT intron, read, CASE WHEN a <= start - 3 AND z >= start + 3 THEN 'PRIME_5' WHEN a >= start AND z <= e THEN 'INTRON' WHEN a <= e - 3 AND z >= e + 3 THEN 'PRIME_3' ELSE 'DISCARD' END AS kind FROM b JOIN {_I} i ON i.chrom = b.chrom AND z > start AND a < e)
SELECT intron, count(*) FILTER (kind = 'PRIME_5') AS p5, count(*) FILTER (kind = 'PRIME_3') AS p3 FROM h GROUP BY 1)"""


def introns(s, d):
    at, n = F.col("s_suppkey") * 37 % 5000, F.col("s_nationkey") % 3
    return A.table(s, d, "supplier").select(F.col("s_suppkey").alias("intron"), F.when(n == 0, "A").when(n == 1, "N").otherwise("R").alias("chrom"), at.alias("start"), (at + 60).alias("end"))


@query("intron_boundary_counts", f"SELECT * FROM {_IC}")
def intron_boundary_counts(s, d):
    return E.intron_counts(reads(s, d), introns(s, d), 3, 64)


@query("retained_introns", f"SELECT intron, '5''' AS edge, p5 AS count FROM {_IC} WHERE p5 > 0 AND p3 > 0 UNION ALL SELECT intron, '3''', p3 FROM {_IC} WHERE p5 > 0 AND p3 > 0")
def retained_introns(s, d):
    return E.retained(intron_boundary_counts(s, d))


@query("umi_alleles", """WITH f AS (SELECT l_suppkey AS site, l_partkey % 200 AS cell, l_orderkey % 50 AS umi,
first(l_linestatus = 'O' ORDER BY l_orderkey * 10 + l_linenumber, l_linestatus = 'O') AS alt FROM lineitem GROUP BY 1, 2, 3)
SELECT site, cell, count(*) FILTER (NOT alt) AS ref, count(*) FILTER (alt) AS alt FROM f GROUP BY 1, 2""")
def umi_alleles(s, d):
    k = F.col("l_orderkey")
    calls = A.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("site"), (F.col("l_partkey") % 200).alias("cell"), (k % 50).alias("umi"), (k * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_linestatus") == "O").alias("is_alt")
    )
    return E.umi_alleles(calls)


_G = "(SELECT l_suppkey AS variant, l_partkey % 100 AS cell, count(*) FILTER (l_returnflag = 'A') AS alt, count(*) AS total FROM lineitem GROUP BY 1, 2)"


@query("genotype_calls", f"SELECT variant, cell, CASE WHEN total < 3 THEN NULL WHEN alt / total >= 0.6 THEN 'CARRIER' WHEN alt / total <= 0.1 THEN 'REFERENCE' ELSE 'AMBIGUOUS' END AS call FROM {_G}")
def genotype_calls(s, d):
    g = A.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("variant"), (F.col("l_partkey") % 100).alias("cell")).agg(F.count_if(F.col("l_returnflag") == "A").alias("alt"), F.count("*").alias("total"))
    return g.select("variant", "cell", E.genotype(F.col("alt"), F.col("total"), 3, 0.6, 0.1).alias("call"))


@query("heteroplasmy", "SELECT site, base, n AS alt, CAST(depth AS BIGINT) AS depth FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS depth, row_number() OVER (PARTITION BY site ORDER BY n DESC, base) AS k FROM (SELECT l_partkey AS site, l_returnflag AS base, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 2 AND depth >= 20 AND n >= 5 AND n / depth BETWEEN 0.001 AND 0.35")
def heteroplasmy(s, d):
    n = A.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("base")).agg(F.count("*").alias("n"))
    return E.second_base(n, 20, 5, 0.001, 0.35)


def tumour_normal(s, d):
    c = A.counts(s, d)
    return c.filter("sample in ('AF', 'AO')"), c.filter("sample not in ('AF', 'AO')")


@query("tumour_specific_mean", f"WITH t AS (SELECT feature, sum(count) / 2 AS a FROM {COUNTS} WHERE sample IN ('AF', 'AO') GROUP BY 1), n AS (SELECT feature, sum(count) / 4 AS b FROM {COUNTS} WHERE sample NOT IN ('AF', 'AO') GROUP BY 1) SELECT feature, round(a, 6) AS mean_tumour, round(coalesce(b, 0), 6) AS mean_normal FROM t LEFT JOIN n USING (feature) WHERE coalesce(b, 0) < 120 AND a - coalesce(b, 0) > 40")
def tumour_specific_mean(s, d):
    return T.specific_by_mean(*tumour_normal(s, d), 2, 4, 120, 40).select("feature", R("mean_tumour").alias("mean_tumour"), R("mean_normal").alias("mean_normal"))


@query("tumour_specific_prevalence", f"WITH t AS (SELECT feature, count(DISTINCT sample) / 2 AS tumour FROM {COUNTS} WHERE sample IN ('AF', 'AO') AND count > 40 GROUP BY 1), n AS (SELECT feature, count(DISTINCT sample) / 4 AS normal FROM {COUNTS} WHERE sample NOT IN ('AF', 'AO') AND count > 40 GROUP BY 1) SELECT feature, tumour, coalesce(normal, 0) AS normal FROM t LEFT JOIN n USING (feature) WHERE tumour > 0.5 AND coalesce(normal, 0) < 0.6")
def tumour_specific_prevalence(s, d):
    t, n = tumour_normal(s, d)
    return T.specific_by_prevalence(t.filter("count > 40"), n.filter("count > 40"), 2, 4, 0.5, 0.6)


@query("marker_blocks", f"SELECT feature, CASE WHEN n = 1 THEN 'unique:' || l WHEN n = 3 THEN 'global' ELSE 'shared:' || l END AS block, n FROM (SELECT feature, string_agg(DISTINCT left(sample, 1), '|' ORDER BY left(sample, 1)) AS l, count(DISTINCT left(sample, 1)) AS n FROM {COUNTS} WHERE count >= 49 GROUP BY 1)")
def marker_blocks(s, d):
    return T.marker_blocks(A.counts(s, d).filter("count >= 49").select("feature", F.left("sample", F.lit(1)).alias("level")), 3)


@query("edge_classes", f"WITH e AS (SELECT gene, feature, coalesce(sum(count) FILTER (sample = 'AF'), 0) AS a, coalesce(sum(count) FILTER (sample = 'RF'), 0) AS b FROM {COUNTS} GROUP BY 1, 2) SELECT gene, feature, CASE WHEN a < 20 AND b >= 20 THEN 'gained' WHEN a >= 20 AND b < 20 THEN 'lost' WHEN a >= 20 AND b >= 20 AND abs(log2((b + 1) / (a + 1))) >= 0.5 THEN 'quantitative' ELSE 'unchanged' END AS class FROM e")
def edge_classes(s, d):
    n = lambda x: F.coalesce(F.sum(F.when(F.col("sample") == x, F.col("count"))), F.lit(0))
    e = A.counts(s, d).groupBy("gene", "feature").agg(n("AF").alias("a"), n("RF").alias("b"))
    return T.edge_classes(e, 20, 0.5).select("gene", "feature", "class")


_SC = f"(SELECT gene AS cell, sample AS player, CAST(sum(count) AS BIGINT) AS m1, count(*) AS m2 FROM {COUNTS} GROUP BY 1, 2)"


@query("shapley_scores", f"SELECT cell, player, round(CASE WHEN m1 = max(m1) OVER (PARTITION BY cell) THEN 1.0 / count(*) OVER (PARTITION BY cell, m1) ELSE 0 END + (rank() OVER (PARTITION BY cell ORDER BY m1) - 1) * 0.01 + CASE WHEN m2 = max(m2) OVER (PARTITION BY cell) THEN 1.0 / count(*) OVER (PARTITION BY cell, m2) ELSE 0 END + (rank() OVER (PARTITION BY cell ORDER BY m2) - 1) * 0.01, 6) AS value FROM {_SC}")
def shapley_scores(s, d):
    sc = A.counts(s, d).groupBy(F.col("gene").alias("cell"), F.col("sample").alias("player")).agg(F.sum("count").alias("m1"), F.count("*").alias("m2"))
    return T.shapley(sc, "player", "cell", ["m1", "m2"]).withColumn("value", R("value"))


@query("arm_calls", f"""WITH g AS (SELECT gene, chrom, count(*) AS n, sum(value / 20) AS s, sum(value / 20 * (value / 20)) AS q FROM {POSITIONS} GROUP BY 1, 2), l AS (SELECT *, unnest([0.5, 1.0, 1.5, 2.0, 2.5]) AS r FROM g), k AS (SELECT *, -(q - 2 * r * s + n * r * r) / (2 * 0.25) AS ll, -(q - 2 * s + n) / (2 * 0.25) AS base FROM l)
SELECT gene, chrom, CASE WHEN 2 * (max(ll) - any_value(base)) >= 3 THEN CAST(arg_max(r, ll) AS DOUBLE) ELSE 1.0 END AS ratio, round(2 * (max(ll) - any_value(base)), 4) AS gain FROM k GROUP BY 1, 2""")
def arm_calls(s, d):
    b = A.positions(s, d).withColumn("value", F.col("value") / 20)
    return T.arm_calls(b, "gene", "chrom", "value", 0.5, 3, [0.5, 1.0, 1.5, 2.0, 2.5]).withColumn("gain", R("gain", 4))


@query("event_cross_match", "WITH a AS (SELECT o_orderkey AS event, unnest([o_custkey, o_custkey + 1]) AS j, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS sign FROM orders), b AS (SELECT c_custkey AS other, unnest([c_custkey * 3, c_custkey * 5]) AS j, CASE WHEN c_acctbal > 5000 THEN 1 ELSE -1 END AS sign FROM customer) SELECT DISTINCT event, other, CASE WHEN a.sign = 0 OR b.sign = 0 THEN 'unknown' WHEN a.sign = b.sign THEN 'match' ELSE 'opposite' END AS match FROM a JOIN b USING (j)")
def event_cross_match(s, d):
    o, c = A.table(s, d, "orders"), A.table(s, d, "customer")
    a = o.select(F.col("o_orderkey").alias("event"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("junctions"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("sign"))
    b = c.select(F.col("c_custkey").alias("event"), F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 5).alias("junctions"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(-1).alias("sign"))
    return T.event_matches(a, b)


@query("population_coverage", "WITH f AS (SELECT n_regionkey AS race, sum(c_acctbal / 10000 / 300) AS f FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1) SELECT race, round(1 - (1 - least(1, f)) * (1 - least(1, f)), 6) AS coverage FROM f")
def population_coverage(s, d):
    f = A.table(s, d, "customer").join(A.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("race"), F.col("c_nationkey").alias("allele"), (F.col("c_acctbal") / 10000 / 300).alias("frequency"))
    return T.population_coverage(A.table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("allele")), f).withColumn("coverage", R("coverage"))


@query("response_signatures", f"WITH w AS (SELECT sample AS ligand, gene, sum(count) / 10000.0 AS weight FROM {COUNTS} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY weight DESC, gene) AS k FROM w WHERE weight > 0.001) SELECT ligand, gene, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY ligand)), 6) AS weight FROM k WHERE k <= 25")
def response_signatures(s, d):
    w = A.counts(s, d).groupBy(F.col("sample").alias("ligand"), "gene").agg((F.sum("count") / 10000.0).alias("weight"))
    return T.signatures(w, 0.001, 25).withColumn("weight", R("weight"))


@query("threshold_sweep", f"SELECT t AS threshold, count(*) FILTER (total >= t) AS genes, CAST(coalesce(sum(total) FILTER (total >= t), 0) AS BIGINT) AS total FROM (SELECT gene, CAST(sum(value) AS BIGINT) AS total FROM {MATRIX} GROUP BY 1) CROSS JOIN (SELECT unnest([1000, 5000, 12000, 15000, 16000]) AS t) GROUP BY 1")
def threshold_sweep(s, d):
    g = A.matrix(s, d).groupBy("gene").agg(F.sum("value").alias("total"))
    t = g.withColumn("threshold", F.explode(F.array(*map(F.lit, (1000, 5000, 12000, 15000, 16000)))))
    over = F.col("total") >= F.col("threshold")
    return t.groupBy("threshold").agg(F.count_if(over).alias("genes"), F.sum(F.when(over, F.col("total")).otherwise(0)).alias("total"))


@query("sex_inference", f"SELECT donor, round(sum(value) FILTER (gene < 10) / sum(value), 6) AS y_share, CASE WHEN sum(value) FILTER (gene < 10) / sum(value) > 0.1 THEN 'male' ELSE 'female' END AS sex FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1")
def sex_inference(s, d):
    g = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("donor").agg((F.sum(F.when(F.col("gene") < 10, F.col("value")).otherwise(0)) / F.sum("value")).alias("y"))
    return g.select("donor", R("y").alias("y_share"), F.when(F.col("y") > 0.1, "male").otherwise("female").alias("sex"))


@query("batch_centring", f"WITH l AS (SELECT gene, donor, state, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2, 3) SELECT gene, donor, state, round(greatest(0, v - avg(v) OVER (PARTITION BY gene, donor) + avg(v) OVER (PARTITION BY gene)), 6) AS v FROM l")
def batch_centring(s, d):
    from pyspark.sql.window import Window as W

    v = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor", "state").agg(F.avg("value").alias("v"))
    return v.select("gene", "donor", "state", R(F.greatest(F.lit(0.0), F.col("v") - F.avg("v").over(W.partitionBy("gene", "donor")) + F.avg("v").over(W.partitionBy("gene")))).alias("v"))
