"""Queries on scores of communication, markers, sets, isoforms and variants, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.functions import special as P
from exonloom.operators import scoring as C
from exonloom.operators import stats as T
from exonloom.operators.networks import ambient_profile
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import COUNTS, MATRIX, OBS

R = lambda c, n=6: F.round(c, n)
_ST = f"(SELECT state, gene, avg(value) AS value FROM {MATRIX} JOIN {OBS} USING (cell) WHERE gene % 3 > 0 OR state < 'C' GROUP BY 1, 2)"


def states(s, d):
    m = A.matrix(s, d).join(A.obs(s, d), "cell").filter("gene % 3 > 0 or state < 'C'")
    return m.groupBy("state", "gene").agg(F.avg("value").alias("value"))


_DELTA = f"""(WITH s AS (SELECT DISTINCT state FROM {_ST}), f AS (SELECT s.state, g.gene, coalesce(value, 0) AS value FROM s CROSS JOIN (SELECT DISTINCT gene FROM {_ST}) g LEFT JOIN {_ST} x ON x.state = s.state AND x.gene = g.gene)
SELECT state, gene, value - median(value) OVER (PARTITION BY gene) AS delta FROM f)"""


@query("receiver_delta", f"SELECT state, gene, round(delta, 6) AS delta FROM {_DELTA}")
def receiver_delta(s, d):
    return C.receiver_delta(states(s, d)).withColumn("delta", R("delta"))


@query("receiver_delta_baseline", f"""SELECT x.state, x.gene, round(x.value - coalesce(b.value, 0), 6) AS delta FROM (SELECT s.state, g.gene, coalesce(value, 0) AS value FROM (SELECT DISTINCT state FROM {_ST}) s
CROSS JOIN (SELECT DISTINCT gene FROM {_ST}) g LEFT JOIN {_ST} y ON y.state = s.state AND y.gene = g.gene) x LEFT JOIN {_ST} b ON b.state = 'BUILDING' AND b.gene = x.gene""")
def receiver_delta_baseline(s, d):
    return C.receiver_delta(states(s, d), "BUILDING").withColumn("delta", R("delta"))


_RESP = "(SELECT 'L' || n_nationkey AS key, s_suppkey AS gene, s_acctbal / 1000 AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'P' || (s_nationkey % 5), s_suppkey, 1.0 FROM supplier WHERE s_suppkey % 2 = 0)"
_EDGE = f"(SELECT DISTINCT 'L' || (n_nationkey * 2) AS ligand, 'P' || (n_nationkey % 7) AS pathway, state AS receiver, n_nationkey AS lr_key, CAST((n_nationkey * 7) % 11 AS DOUBLE) / (length(state) + 1) AS lr FROM nation, {OBS})"


def edges(s, d):
    k = F.col("n_nationkey")
    named = A.obs(s, d).select(F.col("state").alias("receiver")).distinct()
    n = A.table(s, d, "nation").select(k)
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    e = n.crossJoin(F.broadcast(named))  # 25 nations and five states
    return e.select(text("L", k * 2).alias("ligand"), text("P", k % 7).alias("pathway"), "receiver", k.alias("lr_key"), ((k * 7 % 11).cast("double") / (F.length("receiver") + 1)).alias("lr"))


def response(s, d):
    sup = A.table(s, d, "supplier")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    one = sup.select(text("L", F.col("s_nationkey")).alias("key"), F.col("s_suppkey").alias("gene"), (F.col("s_acctbal") / 1000).alias("weight"))
    return one.unionByName(sup.filter("s_suppkey % 2 = 0").select(text("P", F.col("s_nationkey") % 5).alias("key"), F.col("s_suppkey").alias("gene"), F.lit(1.0).alias("weight")))


_RR = f"""(WITH g AS (SELECT DISTINCT gene FROM {_DELTA} INTERSECT SELECT DISTINCT gene FROM {_RESP}), d AS (SELECT * FROM {_DELTA} WHERE gene IN (SELECT gene FROM g)), r AS (SELECT * FROM {_RESP} WHERE weight != 0 AND gene IN (SELECT gene FROM g)),
k AS (SELECT e.*, CASE WHEN ligand IN (SELECT key FROM r) THEN ligand WHEN pathway IN (SELECT key FROM r) THEN pathway END AS response_key FROM {_EDGE} e),
c AS (SELECT state, key, sum(delta * weight) AS dot, any_value(dn) AS dn, any_value(rn) AS rn FROM d JOIN r USING (gene) JOIN (SELECT state, sqrt(sum(delta * delta)) AS dn FROM d GROUP BY 1) USING (state)
JOIN (SELECT key, sqrt(sum(weight * weight)) AS rn FROM r GROUP BY 1) USING (key) GROUP BY 1, 2)
SELECT k.*, coalesce(CASE WHEN dn * rn > 1e-12 THEN dot / (dn * rn) ELSE 0 END, 0) AS promotion, coalesce(u.n, 0) AS genes_used
FROM k LEFT JOIN c ON c.state = receiver AND c.key = response_key LEFT JOIN (SELECT key, count(*) AS n FROM r GROUP BY 1) u ON u.key = response_key)"""


def responses(s, d):
    return C.receiver_response(edges(s, d), C.receiver_delta(states(s, d)), response(s, d), ["ligand", "pathway"])


@query("receiver_response", f"SELECT ligand, pathway, receiver, response_key, round(promotion, 6) AS promotion, round(greatest(promotion, 0), 6) AS response, genes_used FROM {_RR}")
def receiver_response(s, d):
    return responses(s, d).select("ligand", "pathway", "receiver", "response_key", R("promotion").alias("promotion"), R("response").alias("response"), "genes_used")


_FS = f"(SELECT *, greatest(0, least(1, 0.55 * lr / ((SELECT max(lr) FROM {_EDGE}) + 1e-12) + 0.3 * greatest(promotion, 0) + 0.15 * greatest(promotion, 0))) AS score FROM {_RR})"


@query("final_scores", f"SELECT ligand, receiver, round(score, 6) AS score, round(rank() OVER (PARTITION BY lr_key ORDER BY lr DESC) / count(*) OVER (PARTITION BY lr_key), 6) AS p_within FROM {_FS}")
def final_scores(s, d):
    return C.final_scores(responses(s, d)).select("ligand", "receiver", R("score").alias("score"), R("p_within").alias("p_within"))


@query("sampling_stability", f"""SELECT count(*) AS shared, count(*) / 20.0 AS share FROM (SELECT gene, state FROM {_ST} ORDER BY round(value, 9) DESC, gene, state LIMIT 20) JOIN
(SELECT gene, state FROM (SELECT state, gene, avg(value) AS value FROM {MATRIX} JOIN {OBS} USING (cell) WHERE (gene % 3 > 0 OR state < 'C') AND cell % 2 = 0 GROUP BY 1, 2) ORDER BY round(value, 9) DESC, gene, state LIMIT 20) USING (gene, state)""")
def sampling_stability(s, d):
    half = A.matrix(s, d).filter("cell % 2 = 0").join(A.obs(s, d), "cell").filter("gene % 3 > 0 or state < 'C'").groupBy("state", "gene").agg(F.avg("value").alias("value"))
    scored = lambda df: df.withColumn("score", F.round("value", 9))
    return C.edge_stability(scored(states(s, d)), scored(half), ["gene", "state"], 20)


_MK = f"(SELECT state, gene, round(avg(value) / 25 - 1, 4) AS lfc, (gene * 37 + length(state)) % 100 / 1000.0 AS p FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2)"


@query("combined_marker_rank", f"""SELECT state, gene, rank_lfc, rank_p, (rank_lfc + rank_p) / 2 AS combo FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY lfc DESC, gene) - 1 AS rank_lfc,
row_number() OVER (PARTITION BY state ORDER BY p, gene) - 1 AS rank_p FROM {_MK} WHERE lfc > 0) WHERE p < 0.05""")
def combined_marker_rank(s, d):
    m = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("state", "gene").agg(F.round(F.avg("value") / 25 - 1, 4).alias("lfc"))
    m = m.withColumn("p", (F.col("gene") * 37 + F.length("state")) % 100 / 1000)
    return C.combined_rank(m, "state").select("state", "gene", F.col("rank_lfc").cast("bigint").alias("rank_lfc"), F.col("rank_p").cast("bigint").alias("rank_p"), "combo")


_W = f"""(WITH n AS (SELECT state, count(*) AS n1, (SELECT count(*) FROM {OBS}) - count(*) AS n2 FROM {OBS} GROUP BY 1), a AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM {MATRIX} GROUP BY 1),
o AS (SELECT gene, state, sum(value) AS s1, sum(value * value) AS q1 FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2),
m AS (SELECT state, gene, n1, n2, s1 / n1 AS mean, (s - s1) / n2 AS rest, q1, q - q1 AS q2 FROM o JOIN a USING (gene) JOIN n USING (state) WHERE n1 > 1 AND n2 > 1),
v AS (SELECT *, (q1 - n1 * mean * mean) / (n1 - 1) / n1 AS a, (q2 - n2 * rest * rest) / (n2 - 1) / n2 AS b FROM m)
SELECT state, gene, mean, rest, (mean - rest) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM v WHERE a + b > 1e-12)"""


@query("welch_t", f"SELECT state, gene, round(mean, 6) AS mean, round(rest, 6) AS rest, round(t, 6) AS t, round(df, 4) AS df FROM {_W}")
def welch_t(s, d):
    return C.welch(A.matrix(s, d), A.obs(s, d)).withColumns({"mean": R("mean"), "rest": R("rest"), "t": R("t"), "df": R("df", 4)})


@query("ranked_genes", f"SELECT state, gene, place FROM (SELECT state, gene, row_number() OVER (PARTITION BY state ORDER BY round(t, 9) DESC, gene) AS place FROM {_W}) WHERE place <= 25")
def ranked_genes(s, d):
    t = C.welch(A.matrix(s, d), A.obs(s, d)).withColumn("t", F.round("t", 9))
    return C.rank_genes(t, "state", "t", 25).select("state", "gene", F.col("place").cast("bigint").alias("place"))


_SET = """(WITH b AS (SELECT p_partkey AS gene FROM part WHERE p_size % 4 > 0), q AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity = 50 AND l_discount < 0.03 AND l_partkey IN (SELECT gene FROM b)),
t AS (SELECT DISTINCT p_brand AS term, p_partkey AS gene FROM part WHERE p_partkey IN (SELECT gene FROM b))
SELECT term, count(*) AS k, any_value(z) AS term_size, (SELECT count(*) FROM q) AS query_size, (SELECT count(*) FROM b) AS background FROM t JOIN q USING (gene) JOIN (SELECT term, count(*) AS z FROM t GROUP BY 1) USING (term) GROUP BY 1 HAVING count(*) >= 2)"""


def set_overlap(s, d):
    part = A.table(s, d, "part")
    q = A.table(s, d, "lineitem").filter("l_quantity = 50 and l_discount < 0.03").select(F.col("l_partkey").alias("gene"))
    bg = part.filter("p_size % 4 > 0").select(F.col("p_partkey").alias("gene"))
    return C.set_overlaps(part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")), q, bg, 2)


_HYPER = """sum(exp(lgamma(term_size + 1) - lgamma(i + 1) - lgamma(term_size - i + 1) + lgamma(background - term_size + 1) - lgamma(query_size - i + 1) - lgamma(background - term_size - query_size + i + 1)
- lgamma(background + 1) + lgamma(query_size + 1) + lgamma(background - query_size + 1)))"""


@query("set_enrichment", f"""WITH p AS (SELECT term, k, any_value(term_size) AS term_size, any_value(query_size) AS query_size, any_value(background) AS background, least(1.0, {_HYPER}) AS p
FROM (SELECT *, unnest(generate_series(k, least(term_size, query_size))) AS i FROM {_SET} WHERE term_size + query_size - background <= k) GROUP BY 1, 2),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY round(p, 12), term) AS raw FROM p)
SELECT term, k, round(k / (query_size * term_size / background), 6) AS fold, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY round(p, 12) DESC, term DESC)), 6) AS q FROM r""")
def set_enrichment(s, d):
    from exonloom.operators.ranking import with_q

    t = set_overlap(s, d).filter("term_size + query_size - background <= k")
    t = t.withColumn("p", F.round(P.as_udf(P.hypergeometric_sf)("k", "background", "term_size", "query_size"), 12))
    return with_q(t, [], "p", ["term"]).select("term", "k", R("fold").alias("fold"), R("p").alias("p"), R("q").alias("q"))


_MED = "(SELECT DISTINCT l_returnflag AS cluster, l_suppkey % 20 AS tf, l_partkey AS target FROM lineitem WHERE l_quantity > 45)"
_UNI = "(SELECT DISTINCT l_suppkey % 20 AS tf, l_partkey AS target FROM lineitem)"
_TF = f"""(SELECT cluster, tf, a, k - a AS b, t - a AS c, n - k - t + a AS d FROM (SELECT cluster, tf, count(*) AS a FROM {_MED} GROUP BY 1, 2 HAVING count(*) >= 2) JOIN (SELECT cluster, count(*) AS k FROM {_MED} GROUP BY 1) USING (cluster)
JOIN (SELECT tf, count(*) AS t FROM {_UNI} GROUP BY 1) USING (tf), (SELECT count(*) AS n FROM {_UNI}))"""


def tf_tables(s, d):
    line = A.table(s, d, "lineitem")
    edge = [(F.col("l_suppkey") % 20).alias("tf"), F.col("l_partkey").alias("target")]
    marks = line.filter("l_quantity > 45").select(F.col("l_returnflag").alias("cluster"), *edge).distinct()
    return C.edge_tables(marks, line.select(*edge).distinct())


@query("tf_edge_enrichment", f"""SELECT cluster, tf, a, b, c, d, round(least(1.0, sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - a - c + i + 1)
- lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)))), 6) AS p FROM (SELECT *, unnest(generate_series(greatest(a, a - d), least(a + b, a + c))) AS i FROM {_TF}) GROUP BY 1, 2, 3, 4, 5, 6""")
def tf_edge_enrichment(s, d):
    return tf_tables(s, d).withColumn("p", R(P.as_udf(P.fisher_greater)("a", "b", "c", "d")))


@query("artifact_enrichment", f"""WITH p AS (SELECT term, round(least(1.0, {_HYPER}), 12) AS p FROM (SELECT *, unnest(generate_series(k, least(term_size, query_size))) AS i FROM (SELECT term, k, term_size, query_size, 20000 AS background FROM {_SET})) GROUP BY 1),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY round(p, 12), term) AS raw FROM p)
SELECT term, round(-log10(greatest(least(1.0, min(raw) OVER (ORDER BY round(p, 12) DESC, term DESC)), 1e-8)), 4) AS score FROM r""")
def artifact_enrichment(s, d):
    from exonloom.operators.ranking import with_q

    t = set_overlap(s, d).withColumn("background", F.lit(20000).cast("bigint"))
    t = t.withColumn("p", F.round(P.as_udf(P.hypergeometric_sf)("k", "background", "term_size", "query_size"), 12))
    return with_q(t, [], "p", ["term"]).select("term", R(-F.log10(F.greatest("q", F.lit(1e-8))), 4).alias("score"))


_SH = f"(SELECT gene AS cell, sample AS player, CAST(sum(count) AS DOUBLE) / 1000 AS m1, CAST(count(*) AS DOUBLE) / 100 AS m2 FROM {COUNTS} GROUP BY 1, 2)"
_SHL = f"(SELECT cell, player, metric, v FROM (SELECT cell, player, m1, m2 FROM {_SH}) UNPIVOT (v FOR metric IN (m1, m2)))"
_SHK = f"""(SELECT *, count(*) OVER (PARTITION BY cell, metric) AS n, count(*) OVER (PARTITION BY cell, metric ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS p,
count(*) OVER (PARTITION BY cell, metric ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND 0.01 FOLLOWING) - 1 AS k, max(player) OVER (PARTITION BY cell) AS last, max(v) OVER (PARTITION BY cell, metric) AS top FROM {_SHL})"""


def shares(s, d):
    return A.counts(s, d).groupBy(F.col("gene").alias("cell"), F.col("sample").alias("player")).agg((F.sum("count").cast("double") / 1000).alias("m1"), (F.count("*").cast("double") / 100).alias("m2"))


_CH = "CASE WHEN {b} >= 0 AND {b} <= {a} THEN factorial(CAST({a} AS INTEGER)) / factorial(CAST({b} AS INTEGER)) / factorial(CAST({a} - ({b}) AS INTEGER)) ELSE 0 END"
_WT = "factorial(CAST(s AS INTEGER)) * factorial(CAST(n - s - 1 AS INTEGER)) / factorial(CAST(n AS INTEGER))"


def _sizes(pay: str) -> str:
    return f"SELECT cell, player, round(sum(CAST({_WT} AS DOUBLE) * ({pay})), 6) AS value FROM (SELECT *, unnest(generate_series(1, n - 1)) AS s FROM {_SHK}) GROUP BY 1, 2"


@query("credits_shapley", _sizes(f"{_CH.format(a='n - 1', b='s')} + p * ({_CH.format(a='(n - 2)', b='(s - 1)')}) + (k - p) * ({_CH.format(a='(k - 1)', b='(s - 1)')})"))
def credits_shapley(s, d):
    return C.credits(shares(s, d), "player", "cell", ["m1", "m2"], "shapley").withColumn("value", R("value"))


@query("credits_all_or_none", _sizes(f"(s + 1) * ({_CH.format(a='k', b='s')})"))
def credits_all_or_none(s, d):
    return C.credits(shares(s, d), "player", "cell", ["m1", "m2"], "shapley_all_or_none").withColumn("value", R("value"))


_PLACE = "CASE WHEN player = last AND v + 0.01 >= top THEN n ELSE p + 1 END"


@query("credits_rank", f"SELECT cell, player, CAST(sum({_PLACE}) AS DOUBLE) AS value FROM {_SHK} GROUP BY 1, 2")
def credits_rank(s, d):
    return C.credits(shares(s, d), "player", "cell", ["m1", "m2"], "rank")


@query("credits_rank_all_or_none", f"SELECT cell, player, value FROM {_SH} JOIN (SELECT cell, CAST(count(*) FILTER (player = last AND {_PLACE} = n) * max(n) AS DOUBLE) AS value FROM {_SHK} GROUP BY 1) USING (cell)")
def credits_rank_all_or_none(s, d):
    return C.credits(shares(s, d), "player", "cell", ["m1", "m2"], "rank_all_or_none")


_VAR = "(SELECT l_suppkey AS variant, l_returnflag AS grp, count(*) FILTER (l_quantity > 25) AS alt, count(*) AS depth FROM lineitem GROUP BY 1, 2)"


@query("informative_variants", f"""WITH c AS (SELECT variant, grp, alt / depth AS v, CASE grp WHEN 'A' THEN 0.1 WHEN 'N' THEN 0.5 ELSE 0.9 END AS x FROM {_VAR} WHERE depth >= 20),
r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY v) + (count(*) OVER (PARTITION BY variant, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY variant ORDER BY x) AS rx FROM c)
SELECT variant, round(corr(rv, rx), 6) AS rho FROM r GROUP BY 1 HAVING count(*) = 3 AND abs(corr(rv, rx)) >= 0.7""")
def informative_variants(s, d):
    c = A.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("variant"), F.col("l_returnflag").alias("grp")).agg(F.count_if(F.col("l_quantity") > 25).alias("alt"), F.count("*").alias("depth"))
    return C.informative_variants(c, ["A", "N", "R"], [0.1, 0.5, 0.9], 20).withColumn("rho", R("rho"))


_BASE = "(SELECT l_partkey AS site, ['A', 'C', 'G', 'T', 'N'][l_suppkey % 5 + 1] AS base, CAST(l_quantity AS BIGINT) AS quality FROM lineitem)"
_PILE = f"(SELECT site, count(*) FILTER (base = 'A') AS \"A\", count(*) FILTER (base = 'C') AS \"C\", count(*) FILTER (base = 'G') AS \"G\", count(*) FILTER (base = 'T') AS \"T\", count(*) AS depth FROM {_BASE} WHERE quality >= 13 AND base != 'N' GROUP BY 1)"


def piles(s, d):
    base = F.element_at(F.array(*map(F.lit, "ACGTN")), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return C.base_counts(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("site"), base.alias("base"), F.col("l_quantity").cast("bigint").alias("quality")))


@query("pileup_bases", f"SELECT * FROM {_PILE}")
def pileup_bases(s, d):
    return piles(s, d)


@query("snv_discovery", f"""WITH l AS (SELECT site, depth, base, n, ['A', 'C', 'G', 'T'][site % 4 + 1] AS ref FROM {_PILE} UNPIVOT (n FOR base IN ("A", "C", "G", "T"))),
x AS (SELECT site, depth, ref, max(n) FILTER (base = ref) AS ref_n, first(base ORDER BY n DESC, base) FILTER (base != ref) AS alt, max(n) FILTER (base != ref) AS alt_n FROM l GROUP BY 1, 2, 3)
SELECT site, ref, alt, ref_n, alt_n, depth FROM x WHERE depth >= 10 AND alt_n >= 4 AND alt_n / depth >= 0.25""")
def snv_discovery(s, d):
    ref = A.table(s, d, "part").select(F.col("p_partkey").alias("site"), F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref"))
    return C.discovered_variants(piles(s, d), ref, 10, 4, 0.25)


_DV = f"(SELECT donor AS sample, gene, avg(value) AS value FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2)"


@query("variant_association", f"""SELECT gene, variant, count(*) FILTER (present) AS n1, count(*) FILTER (NOT present) AS n0, round(corr(value, CAST(present AS DOUBLE)), 6) AS r FROM {_DV} JOIN
(SELECT n_nationkey AS sample, v AS variant, n_nationkey % (v + 2) = 0 AS present FROM nation, generate_series(0, 4) g(v)) USING (sample) GROUP BY 1, 2 HAVING count(*) FILTER (present) > 0 AND count(*) FILTER (NOT present) > 0 AND isfinite(corr(value, CAST(present AS DOUBLE)))""")
def variant_association(s, d):
    v = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy(F.col("donor").alias("sample"), "gene").agg(F.avg("value").alias("value"))
    k = F.col("n_nationkey")
    carry = A.table(s, d, "nation").select(k.alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variant")).withColumn("present", F.col("sample") % (F.col("variant") + 2) == 0)
    return C.point_biserial(v, carry, "gene").withColumn("r", R("r"))


_ISO = "(SELECT l_suppkey % 50 AS junction, l_partkey % 9 AS isoform, l_returnflag || l_linestatus AS sample, CAST(sum(l_quantity) AS BIGINT) AS reads FROM lineitem WHERE l_partkey % 11 > 2 GROUP BY 1, 2, 3)"


@query("isoform_importance", f"""WITH t AS (SELECT *, sum(reads) OVER (PARTITION BY junction, sample) AS n FROM {_ISO}), g AS (SELECT junction, isoform, sum(reads / n) FILTER (n >= 500) AS s, sum(reads) AS t FROM t GROUP BY 1, 2)
SELECT junction, isoform, round(CASE WHEN sum(s) OVER (PARTITION BY junction) > 0 THEN coalesce(s, 0) / sum(s) OVER (PARTITION BY junction) ELSE t / sum(t) OVER (PARTITION BY junction) END, 6) AS importance FROM g""")
def isoform_importance(s, d):
    t = A.table(s, d, "lineitem").filter("l_partkey % 11 > 2")
    c = t.select((F.col("l_suppkey") % 50).alias("junction"), (F.col("l_partkey") % 9).alias("isoform"), F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_quantity").cast("bigint").alias("reads"))
    return C.isoform_importance(c, 500).withColumn("importance", R("importance"))


_CE = f"(SELECT gene, condition, avg(value) AS v FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2)"


@query("changed_edges", f"""WITH l AS (SELECT gene, coalesce(max(CASE WHEN v >= 25 THEN v ELSE 0 END) FILTER (condition = 'case'), 0) AS a, coalesce(max(CASE WHEN v >= 25 THEN v ELSE 0 END) FILTER (condition != 'case'), 0) AS b FROM {_CE} GROUP BY 1),
e AS (SELECT s_suppkey AS source, s_suppkey // 3 AS target, sqrt(x.a * y.a) AS one, sqrt(x.b * y.b) AS two FROM supplier JOIN l x ON x.gene = s_suppkey JOIN l y ON y.gene = s_suppkey // 3)
SELECT source, target, round(one, 6) AS one, round(two, 6) AS two, round(two - one, 6) AS change FROM e WHERE one >= 26 OR two >= 26""")
def changed_edges(s, d):
    v = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "condition").agg(F.avg("value").alias("value"))
    v = v.select("gene", F.when(F.col("condition") == "case", 1).otherwise(2).alias("grp"), "value")
    e = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("source"), F.expr("s_suppkey div 3").alias("target"))
    return C.changed_edges(e, v, 25, 26).withColumns({c: R(c) for c in ("one", "two", "change")})


_VEC = "(SELECT vec_id AS cell, label AS cluster, embedding AS x FROM embeddings WHERE label IS NOT NULL)"
_CEN = f"(SELECT cluster, list(m ORDER BY i) AS centroid FROM (SELECT cluster, i, avg(CAST(x[i] AS DOUBLE)) AS m FROM (SELECT cluster, x, unnest(generate_series(1, len(x))) AS i FROM {_VEC}) GROUP BY 1, 2) GROUP BY 1)"


@query("prune_reassign", f"""WITH good AS (SELECT cluster FROM {_VEC} GROUP BY 1 HAVING count(*) >= 30 AND cluster % 4 != 1)
SELECT cell, cluster FROM {_VEC} WHERE cluster IN (SELECT cluster FROM good) UNION ALL
SELECT cell, first(c.cluster ORDER BY round(list_sum(list_transform(list_zip(x, centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), c.cluster) FROM {_VEC} v, {_CEN} c
WHERE v.cluster NOT IN (SELECT cluster FROM good) AND c.cluster IN (SELECT cluster FROM good) GROUP BY 1""")
def prune_reassign(s, d):
    from exonloom.operators.joins import centroids

    cells = A.table(s, d, "embeddings").filter("label is not null").select(F.col("vec_id").alias("cell"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))
    wins = cells.select("cluster").distinct().withColumn("share", F.when(F.col("cluster") % 4 == 1, 0.1).otherwise(0.9))
    return C.reassigned(wins, cells, centroids(cells, "cluster", "x"), 30, 0.25)


_POS = "(SELECT s_nationkey % 4 AS gene, s_suppkey AS pos, s_suppkey % 9 * 3 AS \"A\", s_suppkey % 7 * 2 AS \"C\", s_suppkey % 5 AS \"G\", s_suppkey % 3 AS \"T\" FROM supplier)"
_ALL = "(SELECT s_nationkey % 4 AS gene, s_suppkey AS pos, 'al' || a AS allele, ['A', 'C', 'G', 'T'][(s_suppkey * (a + 1) + a) % 4 + 1] AS base, (a * 7 % 5) / 10 AS frequency FROM supplier, generate_series(0, 5) g(a))"


@query("allele_pairs", f"""WITH l AS (SELECT gene, pos, base, n, sum(n) OVER (PARTITION BY gene, pos) AS depth, row_number() OVER (PARTITION BY gene, pos ORDER BY n DESC, base) AS k FROM {_POS} UNPIVOT (n FOR base IN ("A", "C", "G", "T"))),
r AS (SELECT gene, pos, max(base) FILTER (k = 1) AS x, max(CASE WHEN n / depth >= 0.15 AND n >= 3 THEN base END) FILTER (k = 2) AS y FROM l WHERE depth >= 8 GROUP BY 1, 2),
p AS (SELECT r.gene, a.allele AS one, b.allele AS two, count(*) FILTER ((a.base = x AND b.base = coalesce(y, x)) OR (b.base = x AND a.base = coalesce(y, x))) AS fits, any_value(a.frequency + b.frequency) AS f
FROM r JOIN {_ALL} a ON a.gene = r.gene AND a.pos = r.pos JOIN {_ALL} b ON b.gene = r.gene AND b.pos = r.pos AND a.allele <= b.allele GROUP BY 1, 2, 3)
SELECT gene, one, two, fits FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY fits DESC, f DESC, one != two, one, two) AS k FROM p) WHERE k = 1""")
def allele_pairs(s, d):
    k, gene = F.col("s_suppkey"), (F.col("s_nationkey") % 4).alias("gene")
    sup = A.table(s, d, "supplier")
    pos = sup.select(gene, k.alias("pos"), (k % 9 * 3).alias("A"), (k % 7 * 2).alias("C"), (k % 5).alias("G"), (k % 3).alias("T"))
    al = sup.select(gene, k.alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("a"))
    a = F.col("a")
    base = F.element_at(F.array(*map(F.lit, "ACGT")), ((F.col("pos") * (a + 1) + a) % 4 + 1).cast("int"))
    al = al.select("gene", "pos", F.concat(F.lit("al"), a.cast("string")).alias("allele"), base.alias("base"), (a * 7 % 5 / 10).alias("frequency"))
    return C.allele_pairs(pos, al)


_RHO = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


@query("auto_rho", f"""WITH t AS (SELECT cell, sum(value) AS t FROM {MATRIX} GROUP BY 1), low AS (SELECT cell FROM t WHERE t <= (SELECT quantile_cont(t, 0.1) FROM t)),
s AS (SELECT gene, sum(value) / sum(sum(value)) OVER () AS soup FROM {MATRIX} WHERE cell IN (SELECT cell FROM low) GROUP BY 1), top AS (SELECT gene FROM s ORDER BY soup DESC, gene LIMIT 20),
m AS (SELECT gene, value, t, coalesce(soup, 0) AS soup, gene IN (SELECT gene FROM top) AS amb FROM {MATRIX} JOIN t USING (cell) LEFT JOIN s USING (gene) WHERE t >= (SELECT median(t) FROM t)),
r AS (SELECT rho, sum(greatest(0, value - t * soup * rho)) AS a, sum(greatest(0, value - t * soup * rho)) FILTER (amb) AS b FROM m, (SELECT unnest({[0.0, *_RHO]}) AS rho) GROUP BY 1),
x AS (SELECT r.rho, (z.b / z.a - r.b / r.a) / (z.b / z.a) AS benefit, (z.a - r.a) / z.a AS removed FROM r, (SELECT a, b FROM r WHERE rho = 0) z WHERE r.rho > 0), y AS (SELECT *, benefit - 4 * removed * removed AS score FROM x)
SELECT CAST(rho AS DOUBLE) AS rho, round(benefit, 6) AS benefit, round(removed, 6) AS removed, round(score, 6) AS score, rho = (SELECT min(rho) FROM y WHERE score >= (SELECT max(score) FROM y) - 0.01) AS best FROM y""")
def auto_rho(s, d):
    m = A.matrix(s, d)
    t = C.best_rho(m, ambient_profile(m, 0.1), _RHO, 20, 4.0, 0.01)
    return t.withColumns({c: R(c) for c in ("benefit", "removed", "score")})


@query("burden_association", f"""WITH v AS (SELECT gene, donor, avg(value) AS value FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2), r AS (SELECT gene, donor % 3 = 0 AS mutated, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM v)
SELECT gene, count(*) FILTER (mutated) AS n1, count(*) FILTER (NOT mutated) AS n2, sum(r) FILTER (mutated) - count(*) FILTER (mutated) * (count(*) FILTER (mutated) + 1) / 2 AS u FROM r GROUP BY 1
HAVING count(*) >= 10 AND count(*) FILTER (mutated) > 0 AND count(*) FILTER (NOT mutated) > 0""")
def burden_association(s, d):
    v = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("gene", "donor").agg(F.avg("value").alias("value"))
    v = v.withColumn("mutated", F.when(F.col("donor") % 3 == 0, "yes").otherwise("no"))
    return T.mann_whitney(v, "gene", "mutated", "value", "yes").filter("n1 + n2 >= 10").drop("ties")
