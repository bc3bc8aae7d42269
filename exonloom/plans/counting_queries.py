"""Queries on counts, filters, pseudobulks and normalisation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import counting as C
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import COUNTS, MATRIX, OBS

R = lambda c, n=6: F.round(c, n)


@query("uid_sample_sum", f"SELECT sample, feature, CAST(sum(count) AS BIGINT) AS count FROM {COUNTS} GROUP BY 1, 2")
def uid_sample_sum(s, d):
    return C.sample_feature_sum(A.counts(s, d))


@query("uid_first_meta", f"SELECT feature, first(strand ORDER BY ord, strand) AS strand FROM {COUNTS} GROUP BY 1")
def uid_first_meta(s, d):
    return C.first_seen(A.counts(s, d), "strand")


@query("feature_total_threshold", f"SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM {COUNTS} GROUP BY 1 HAVING sum(count) >= 200")
def feature_total_threshold(s, d):
    return C.total_filter(A.counts(s, d), 200)


@query("min_count_any_sample", f"SELECT feature, CAST(max(c) AS BIGINT) AS top FROM (SELECT sample, feature, sum(count) AS c FROM {COUNTS} GROUP BY 1, 2) GROUP BY 1 HAVING max(c) > 149")
def min_count_any_sample(s, d):
    return C.any_sample_filter(A.counts(s, d), 150)


@query("presence_filter", f"SELECT feature, max(n) AS columns FROM (SELECT feature, strand, count(*) FILTER (c > 20) AS n FROM (SELECT feature, strand, sample, sum(count) AS c FROM {COUNTS} GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3")
def presence_filter(s, d):
    per = A.counts(s, d).groupBy("feature", "strand", "sample").agg(F.sum("count").alias("c"))
    return C.presence_filter(per, "strand", "sample", "c", 20, 3)


@query("gene_sum", f"SELECT sample, gene, CAST(sum(count) AS BIGINT) AS count FROM {COUNTS} GROUP BY 1, 2")
def gene_sum(s, d):
    return A.counts(s, d).groupBy("sample", "gene").agg(F.sum("count").alias("count"))


BULK = f"(SELECT o.state, o.donor, m.gene, CAST(sum(value) AS BIGINT) AS total FROM {MATRIX} m JOIN {OBS} o USING (cell) GROUP BY 1, 2, 3)"
SIZES = f"(SELECT state, donor, count(*) AS cells FROM {OBS} GROUP BY 1, 2)"


@query("pseudobulk_sum", f"SELECT state, donor, gene, total, cells FROM {BULK} JOIN {SIZES} USING (state, donor) WHERE cells >= 5")
def pseudobulk_sum(s, d):
    return C.pseudobulk(A.matrix(s, d), A.obs(s, d).drop("condition"), ["state", "donor"], 5)


@query("pseudobulk_log2cp10k", f"SELECT state, donor, gene, round(log2(total / sum(total) OVER (PARTITION BY state, donor) * 1e4 + 1), 6) AS log2cp10k FROM {BULK}")
def pseudobulk_log2cp10k(s, d):
    bulk = C.pseudobulk(A.matrix(s, d), A.obs(s, d), ["state", "donor"])
    return C.log2_cp10k(bulk, ["state", "donor"]).select("state", "donor", "gene", R("log2cp10k").alias("log2cp10k"))


@query("cpm_ratio", f"""SELECT sample, gene, feature, count, round(count * 1e6 / lib, 6) AS cpm, CASE WHEN g * 1e6 / lib >= 1.0 THEN round(count / g, 6) END AS ratio FROM (
SELECT *, sum(count) OVER (PARTITION BY sample) AS lib, sum(count) OVER (PARTITION BY sample, gene) AS g FROM (SELECT sample, gene, feature, CAST(sum(count) AS BIGINT) AS count FROM {COUNTS} GROUP BY 1, 2, 3))""")
def cpm_ratio(s, d):
    return C.cpm_and_ratio(A.counts(s, d)).withColumns({"cpm": R("cpm"), "ratio": R("ratio")})


@query("state_mean_detection", f"SELECT state, gene, round(sum(value) / any_value(n), 6) AS mean, round(count(*) / any_value(n), 6) AS detection FROM {MATRIX} JOIN {OBS} USING (cell) JOIN (SELECT state, count(*) AS n FROM {OBS} GROUP BY 1) USING (state) GROUP BY 1, 2")
def state_mean_detection(s, d):
    return C.mean_and_detection(A.matrix(s, d), A.obs(s, d)).withColumns({"mean": R("mean"), "detection": R("detection")})


@query("qc_chain", f"""WITH m AS (SELECT * FROM {MATRIX}), a AS (SELECT * FROM m WHERE cell IN (SELECT cell FROM m GROUP BY 1 HAVING count(*) >= 20)),
b AS (SELECT * FROM a WHERE gene IN (SELECT gene FROM a GROUP BY 1 HAVING count(*) >= 30)),
p AS (SELECT cell, count(*) AS genes, CAST(sum(value) AS BIGINT) AS total, coalesce(sum(value) FILTER (gene < 10), 0) AS sp FROM b GROUP BY 1)
SELECT cell, genes, total, round(sp / total, 6) AS special_share FROM p WHERE total >= 500 AND sp / total < 0.2""")
def qc_chain(s, d):
    return C.qc_chain(A.matrix(s, d), 20, 30, 500, F.col("gene") < 10, 0.2).withColumn("special_share", R("special_share"))


@query("sample_metadata_mode", f"SELECT donor, min(state) AS state FROM (SELECT donor, state, count(*) AS n, max(count(*)) OVER (PARTITION BY donor) AS m FROM {OBS} GROUP BY 1, 2) WHERE n = m GROUP BY 1")
def sample_metadata_mode(s, d):
    return C.group_mode(A.obs(s, d), "donor", "state")


@query("composition", f"SELECT donor, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY donor), 6) AS share FROM {OBS} GROUP BY 1, 2")
def composition(s, d):
    return C.composition(A.obs(s, d), "donor", "state").withColumn("share", R("share"))


@query("burden_total_row", f"SELECT coalesce(sample, 'TOTAL') AS sample, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM {COUNTS} GROUP BY ROLLUP (sample)")
def burden_total_row(s, d):
    return C.with_total_row(A.counts(s, d), "sample", "count")


@query("control_stats", f"SELECT feature, round(sum(c) / 6, 6) AS mean, round(sqrt(greatest(sum(c * c) / 6 - (sum(c) / 6) * (sum(c) / 6), 0.0)), 4) AS std, round(least(sqrt(sum(c * c) / 6), 1.0), 6) AS mle, round(count(*) / 6, 6) AS prevalence FROM (SELECT sample, feature, sum(count) AS c FROM {COUNTS} GROUP BY 1, 2) GROUP BY 1")
def control_stats(s, d):
    return C.control_stats(A.counts(s, d), 6).select("feature", R("mean").alias("mean"), R("std", 4).alias("std"), R("mle").alias("mle"), R("prevalence").alias("prevalence"))


@query("neoantigen_frequency", f"SELECT feature, count(DISTINCT sample) AS n, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM {COUNTS} GROUP BY 1")
def neoantigen_frequency(s, d):
    return A.counts(s, d).groupBy("feature").agg(F.count_distinct("sample").alias("n"), F.array_join(F.sort_array(F.collect_set("sample")), ",").alias("samples"))


@query("dense_pivot", f"SELECT feature, {', '.join(f'''CAST(coalesce(sum(count) FILTER (sample = '{x}'), 0) AS BIGINT) AS {x}''' for x in ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))} FROM {COUNTS} GROUP BY 1")
def dense_pivot(s, d):
    return A.counts(s, d).groupBy("feature").pivot("sample", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.sum("count")).fillna(0)


@query("union_of_samples", f"SELECT f.feature, s.sample, CAST(coalesce(c, 0) AS BIGINT) AS count FROM (SELECT DISTINCT feature FROM {COUNTS}) f CROSS JOIN (SELECT DISTINCT sample FROM {COUNTS}) s LEFT JOIN (SELECT sample, feature, sum(count) AS c FROM {COUNTS} GROUP BY 1, 2) USING (sample, feature)")
def union_of_samples(s, d):
    """J3c: every sample has every feature, absent ones as 0: samples are few and known, so each feature is exploded."""
    c = A.counts(s, d)
    samples = c.select("sample").distinct()
    return c.select("feature").distinct().join(F.broadcast(samples)).join(C.sample_feature_sum(c), ["sample", "feature"], "left").select("feature", "sample", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


@query("donor_cell_counts", f"SELECT state, donor, count(*) AS cells FROM {OBS} GROUP BY 1, 2 HAVING count(*) >= 10")
def donor_cell_counts(s, d):
    return A.obs(s, d).groupBy("state", "donor").agg(F.count("*").alias("cells")).filter("cells >= 10")


@query("metacell_sum", f"SELECT cell % 50 AS metacell, gene, CAST(sum(value) AS BIGINT) AS value FROM {MATRIX} GROUP BY 1, 2")
def metacell_sum(s, d):
    """Cells are grouped into 50 metacells by id; all cells take part."""
    return A.matrix(s, d).groupBy((F.col("cell") % 50).alias("metacell"), "gene").agg(F.sum("value").alias("value"))


@query("donor_2x2", f"""SELECT gene, count(*) FILTER (pos AND inc) AS a, count(*) FILTER (pos AND NOT inc) AS b, count(*) FILTER (NOT pos AND inc) AS c, count(*) FILTER (NOT pos AND NOT inc) AS d FROM (
SELECT gene, donor, bool_or(total >= 100) AS pos, bool_or(state = 'BUILDING') AS inc FROM {BULK} GROUP BY 1, 2) GROUP BY 1""")
def donor_2x2(s, d):
    bulk = C.pseudobulk(A.matrix(s, d), A.obs(s, d), ["state", "donor"])
    per = bulk.groupBy("gene", "donor").agg(F.bool_or(F.col("total") >= 100).alias("pos"), F.bool_or(F.col("state") == "BUILDING").alias("inc"))
    return per.groupBy("gene").agg(F.count_if(F.expr("pos and inc")).alias("a"), F.count_if(F.expr("pos and not inc")).alias("b"), F.count_if(F.expr("not pos and inc")).alias("c"), F.count_if(F.expr("not pos and not inc")).alias("d"))


@query("criteria_filter", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 10 AND p_retailprice <= 1500 AND p_size != 20")
def criteria_filter(s, d):
    p = A.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.filter(C.all_of([("p_size", ">", 10), ("p_retailprice", "<=", 1500), ("p_size", "!=", 20)]))


@query("per_gene_max", f"SELECT state, donor, CAST(max(total) AS BIGINT) AS top, count(*) AS genes FROM {BULK} GROUP BY 1, 2")
def per_gene_max(s, d):
    return C.pseudobulk(A.matrix(s, d), A.obs(s, d), ["state", "donor"]).groupBy("state", "donor").agg(F.max("total").alias("top"), F.count("*").alias("genes"))
