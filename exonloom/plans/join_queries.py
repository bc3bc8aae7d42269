"""Queries on interval, lookup, containment and nearest joins and on splicing ratios, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import joins as J
from exonloom.operators import splicing as S
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import COUNTS, INTERVALS, JUNCTIONS, MATRIX, OBS, TOKENS

R = lambda c, n=6: F.round(c, n)

_JUNCTION = f'(SELECT gene, start, "end", sample, CAST(sum(count) AS BIGINT) AS count FROM {JUNCTIONS} GROUP BY ALL)'
_PAIRS = f'''(SELECT a.gene, a.start, a."end", b.start AS other_start, b."end" AS other_end FROM (SELECT DISTINCT gene, start, "end" FROM {JUNCTIONS}) a JOIN (SELECT DISTINCT gene, start, "end" FROM {JUNCTIONS}) b
ON a.gene = b.gene AND greatest(a.start, b.start) < least(a."end", b."end"))'''
_PSI = f'''(SELECT p.gene, p.start, p."end", c.sample, coalesce(own.count, 0) AS inclusion, CAST(sum(c.count) AS BIGINT) AS clique FROM {_PAIRS} p JOIN {_JUNCTION} c ON c.gene = p.gene AND c.start = p.other_start AND c."end" = p.other_end
LEFT JOIN {_JUNCTION} own ON own.gene = p.gene AND own.start = p.start AND own."end" = p."end" AND own.sample = c.sample GROUP BY ALL)'''


@query("psi_ratio", f'SELECT gene, start, "end", sample, inclusion, clique, CASE WHEN clique >= 5 THEN round(inclusion / clique, 6) END AS psi FROM {_PSI}')
def psi_ratio(s, d):
    """The flagship: each junction's share of the counts of its clique, per sample."""
    return S.psi(A.junctions(s, d), 5).withColumn("psi", R("psi"))


@query("psi_background", f'''WITH t AS (SELECT gene, start, "end", sum(count) AS total FROM {JUNCTIONS} GROUP BY ALL) SELECT p.gene, p.start, p."end", arg_min(p.other_start, -t.total * 1000000000000 + p.other_start * 100 + p.other_end - p.other_start) AS background_start,
arg_min(p.other_end, -t.total * 1000000000000 + p.other_start * 100 + p.other_end - p.other_start) AS background_end FROM {_PAIRS} p JOIN t ON t.gene = p.gene AND t.start = p.other_start AND t."end" = p.other_end
WHERE p.start != p.other_start OR p."end" != p.other_end GROUP BY ALL''')
def psi_background(s, d):
    return S.background(A.junctions(s, d))


@query("psi_validity", f'SELECT gene, start, "end", round(max(psi) - min(psi), 6) AS range FROM (SELECT *, CASE WHEN clique >= 5 THEN inclusion / clique END AS psi FROM {_PSI}) GROUP BY ALL HAVING count(*) FILTER (inclusion >= 20) > 1 AND count(*) FILTER (clique >= 20) >= 2 AND max(psi) - min(psi) >= 0.1')
def psi_validity(s, d):
    return S.informative(S.psi(A.junctions(s, d), 5), 20, 0.1).withColumn("range", R("range"))


_BLOCKS = '(SELECT o_orderpriority AS chrom, o_orderkey * 10 + 5 AS b_start, o_orderkey * 10 + 15 AS b_end, o_custkey AS block FROM orders)'


@query("overlap_best_block", f'''SELECT id, block, CAST(shared AS BIGINT) AS shared FROM (SELECT i.id, b.block, least(i."end", b.b_end) - greatest(i.start, b.b_start) AS shared, row_number() OVER (PARTITION BY i.id ORDER BY least(i."end", b.b_end) - greatest(i.start, b.b_start) DESC, b.block, b.b_start) AS k
FROM {INTERVALS} i JOIN {_BLOCKS} b ON i.chrom = b.chrom AND i."end" > b.b_start AND i.start < b.b_end) WHERE k = 1''')
def overlap_best_block(s, d):
    i = A.intervals(s, d).select("chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "id")
    b = A.table(s, d, "orders").select(F.col("o_orderpriority").alias("chrom"), (F.col("o_orderkey") * 10 + 5).alias("b_start"), (F.col("o_orderkey") * 10 + 15).alias("b_end"), F.col("o_custkey").alias("block"))
    both = J.overlap_join(i, b, ["chrom"], 64).withColumn("shared", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    best = both.groupBy("id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "block", "b_start")).alias("x"))
    return best.select("id", "x.block", (-F.col("x.s")).alias("shared"))


@query("overlap_pair_counts", f'SELECT a.id, count(*) AS n FROM {INTERVALS} a JOIN {INTERVALS} b ON a.chrom = b.chrom AND a."end" > b.start AND a.start < b."end" GROUP BY 1')
def overlap_pair_counts(s, d):
    i = A.intervals(s, d)
    side = lambda p: i.select("chrom", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("id").alias(f"{p}_id"))
    return J.overlap_join(side("a"), side("b"), ["chrom"], 64).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"))


@query("point_in_interval", f'''WITH p AS (SELECT o_orderkey AS point_id, o_orderpriority AS chrom, o_orderkey * 10 + 33 AS pos FROM orders), h AS (SELECT p.point_id, i.id, row_number() OVER (PARTITION BY p.point_id ORDER BY i.ord, i.id) AS k FROM p JOIN {INTERVALS} i ON i.chrom = p.chrom AND p.pos >= i.start AND p.pos < i."end")
SELECT p.point_id, h.id FROM p LEFT JOIN (SELECT * FROM h WHERE k = 1) h USING (point_id)''')
def point_in_interval(s, d):
    p = A.table(s, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderpriority").alias("chrom"), (F.col("o_orderkey") * 10 + 33).alias("pos"))
    return J.point_in_interval(p, A.intervals(s, d), ["chrom"], "pos", 64, "id", "ord").select("point_id", "id")


@query("lookup_fallback", "SELECT o_orderkey AS id, coalesce(a.n, b.n) AS n FROM orders LEFT JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) a ON a.k = o_custkey LEFT JOIN (SELECT c_custkey AS k, c_nationkey AS n FROM customer) b ON b.k = o_custkey")
def lookup_fallback(s, d):
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    a = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    b = A.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return J.with_fallback(o, a, b, ["k"], "n").select("id", "n")


@query("inner_join_metadata", f"SELECT m.cell, m.gene, m.value, o.state FROM {MATRIX} m JOIN {OBS} o USING (cell)")
def inner_join_metadata(s, d):
    return A.matrix(s, d).join(A.obs(s, d).select("cell", "state"), "cell")


@query("left_join_covariates", f"SELECT cell, donor, n_name FROM {OBS} LEFT JOIN nation ON n_nationkey = donor AND n_regionkey > 1")
def left_join_covariates(s, d):
    n = A.table(s, d, "nation").filter("n_regionkey > 1").select(F.col("n_nationkey").alias("donor"), "n_name")
    return A.obs(s, d).select("cell", "donor").join(n, "donor", "left")


@query("full_outer_join", f"SELECT feature, CAST(coalesce(a.c, 0) AS BIGINT) AS a, CAST(coalesce(b.c, 0) AS BIGINT) AS b FROM (SELECT feature, sum(count) AS c FROM {COUNTS} WHERE sample = 'AF' GROUP BY 1) a FULL JOIN (SELECT feature, sum(count) AS c FROM {COUNTS} WHERE sample = 'NO' AND count > 30 GROUP BY 1) b USING (feature)")
def full_outer_join(s, d):
    c = A.counts(s, d)
    one = lambda df, n: df.groupBy("feature").agg(F.sum("count").alias(n))
    both = one(c.filter("sample = 'AF'"), "a").join(one(c.filter("sample = 'NO' and count > 30"), "b"), "feature", "full")
    return both.select("feature", F.coalesce("a", F.lit(0)).cast("bigint").alias("a"), F.coalesce("b", F.lit(0)).cast("bigint").alias("b"))


@query("semi_features", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)")
def semi_features(s, d):
    return A.table(s, d, "part").select("p_partkey", "p_brand").join(A.table(s, d, "lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("anti_features", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def anti_features(s, d):
    return A.table(s, d, "part").select("p_partkey", "p_brand").join(A.table(s, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("centroid_argmax", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1), q AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM e GROUP BY 1),
s AS (SELECT e.vec_id, c.label, sum(e.x * c.m) / (any_value(q.n) * any_value(n.n)) AS score FROM e JOIN c USING (i) JOIN n ON n.label = c.label JOIN q ON q.vec_id = e.vec_id GROUP BY 1, 2)
SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s) WHERE k = 1""")
def centroid_argmax(s, d):
    e = A.table(s, d, "embeddings")
    return J.nearest_centroid(e, J.centroids(e, "label", "embedding"), "vec_id", "embedding", "label").withColumn("score", R("score"))


@query("sender_receiver_pairs", f"WITH s AS (SELECT state, donor, avg(value) AS m FROM {MATRIX} JOIN {OBS} USING (cell) GROUP BY 1, 2 HAVING avg(value) > 30) SELECT a.donor, a.state AS sender, b.state AS receiver, round(a.m * b.m, 4) AS product FROM s a JOIN s b ON a.donor = b.donor AND a.state != b.state")
def sender_receiver_pairs(s, d):
    m = A.matrix(s, d).join(A.obs(s, d), "cell").groupBy("state", "donor").agg(F.avg("value").alias("m")).filter("m > 30")
    a, b = m.select("donor", F.col("state").alias("sender"), F.col("m").alias("x")), m.select("donor", F.col("state").alias("receiver"), F.col("m").alias("y"))
    return a.join(b, "donor").filter("sender != receiver").select("donor", "sender", "receiver", R(F.col("x") * F.col("y"), 4).alias("product"))


@query("any_shared_key", "WITH e AS (SELECT o_custkey AS id, o_orderkey % 997 AS k FROM orders UNION SELECT o_custkey, o_orderkey % 991 FROM orders) SELECT DISTINCT e.id, n.n_nationkey AS other FROM e JOIN nation n ON e.k = n.n_nationkey OR e.k = n.n_nationkey + 25")
def any_shared_key(s, d):
    o, n = A.table(s, d, "orders"), A.table(s, d, "nation")
    e = o.select(F.col("o_custkey").alias("id"), F.explode(F.array(F.col("o_orderkey") % 997, F.col("o_orderkey") % 991)).alias("k")).distinct()
    f = n.select(F.col("n_nationkey").alias("other"), F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 25)).alias("k"))
    return e.join(f, "k").select("id", "other").distinct()


@query("token_containment", f"""WITH b AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark), s AS (SELECT item_id, list_slice(t, 2, 7) AS short FROM b WHERE len(t) >= 8)
SELECT s.item_id, d.doc FROM s JOIN {TOKENS} d ON contains('|' || array_to_string(d.tokens, '|') || '|', '|' || array_to_string(s.short, '|') || '|')""")
def token_containment(s, d):
    b = A.table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("t")).filter("size(t) >= 8").select("item_id", F.slice("t", 2, 6).alias("short"))
    return J.contained_tokens(b, A.tokens(s, d).select("doc", F.col("tokens").alias("long")), "doc", "short", "long").select("item_id", "doc")


@query("exact_sequence_join", "SELECT a.doc_id, min(b.doc_id) AS first_copy, count(*) AS copies FROM documents a JOIN documents b ON a.text = b.text GROUP BY 1")
def exact_sequence_join(s, d):
    """Texts are equal if their SHA-256 and their lengths are; they are not compared byte by byte."""
    t = A.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    g = t.groupBy("h", "n").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("copies"))
    return t.join(g, ["h", "n"]).select("doc_id", "first_copy", "copies")
