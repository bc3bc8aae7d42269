"""Queries on tokens, events and strings, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from exonloom.operators import tokens as X
from exonloom.operators.structures import gene_model, junction_decomposition
from exonloom.plans.registry import query
from exonloom.sources import adapters as A
from exonloom.sources.adapters import INTERVALS, TOKENS

_S = "(SELECT o_custkey AS gene, list('E' || (o_orderkey % 9 + 1) || '.' || (o_orderkey % 3 + 1) ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)"


def structures(s, d):
    """(gene, t): a customer's orders in turn, as exon tokens."""
    k = F.col("o_orderkey")
    token = F.concat(F.lit("E"), (k % 9 + 1).cast("string"), F.lit("."), (k % 3 + 1).cast("string"))
    g = A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("gene")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), token.alias("t")))).alias("a"))
    return g.select("gene", F.transform("a", lambda x: x["t"]).alias("t"))


@query("tokens_blocks", f"SELECT gene, len(list_distinct(list_transform(t, lambda x: split_part(x, '.', 1)))) AS blocks, len(list_distinct(t)) AS regions FROM {_S}")
def tokens_blocks(s, d):
    return structures(s, d).select("gene", X.blocks(F.col("t")).cast("bigint").alias("blocks"), X.regions(F.col("t")).cast("bigint").alias("regions"))


@query("adjacent_pairs", f"SELECT gene, array_to_string(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || '-' || x[2]), '|') AS pairs FROM {_S} WHERE len(t) > 1")
def adjacent_pairs(s, d):
    return structures(s, d).filter("size(t) > 1").select("gene", F.array_join(X.adjacent(F.col("t")), "|").alias("pairs"))


@query("junction_core", f"SELECT gene, array_to_string(list_transform(list_filter(list_zip(t, list_prepend('', t)[:-2]), lambda x: x[1] != x[2]), lambda x: x[1]), '|') AS core FROM (SELECT gene, list_transform(t, lambda x: split_part(x, '.', 1)) AS t FROM {_S})")
def junction_core(s, d):
    block = F.transform("t", lambda x: F.split_part(x, F.lit("."), F.lit(1)))
    return structures(s, d).withColumn("b", block).select("gene", F.array_join(X.deduped(F.col("b")), "|").alias("core"))


@query("structure_match", f"SELECT a.gene, b.gene AS other, CASE WHEN a.s = b.s THEN 'exact' WHEN contains(b.s, a.s) THEN 'contained_in' WHEN contains(a.s, b.s) THEN 'superset_of' ELSE 'none' END AS match FROM (SELECT gene, '|' || array_to_string(t[1:3], '|') || '|' AS s FROM {_S}) a JOIN (SELECT gene - 1 AS gene1, gene, '|' || array_to_string(t, '|') || '|' AS s FROM {_S}) b ON b.gene1 = a.gene")
def structure_match(s, d):
    t = structures(s, d)
    a, b = t.select("gene", F.slice("t", 1, 3).alias("x")), t.select((F.col("gene") - 1).alias("gene"), F.col("gene").alias("other"), F.col("t").alias("y"))
    return a.join(b, "gene").select("gene", "other", X.match_class(F.col("x"), F.col("y")).alias("match"))


@query("uid_strings", "SELECT o_orderkey, 'chr' || (o_orderkey % 22 + 1) || ':' || o_orderkey || '-' || (o_orderkey + o_custkey) AS uid, CASE WHEN o_orderkey < o_custkey THEN '+' ELSE '-' END AS strand FROM orders")
def uid_strings(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return A.table(s, d, "orders").select("o_orderkey", X.uid(X.with_chr((k % 22 + 1).cast("string")), k, k + c).alias("uid"), F.when(k < c, "+").otherwise("-").alias("strand"))


@query("event_class", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN 'trans-splicing' WHEN l_partkey % 7 = 0 THEN 'intron-retention' WHEN l_quantity > 40 AND l_discount > 0.05 THEN 'alt5''-alt3''' WHEN l_quantity > 40 THEN 'alt-5'''
WHEN l_discount > 0.05 THEN 'alt-3''' WHEN l_partkey % 2 = l_suppkey % 2 THEN 'cassette-exon' ELSE 'other' END AS event FROM lineitem""")
def event_class(s, d):
    c = F.col
    kind = X.event_class(c("l_partkey") % 2, c("l_suppkey") % 2, c("l_quantity") > 40, c("l_discount") > 0.05, c("l_partkey") % 7 == 0, c("l_suppkey") % 11 == 0)
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("event"))


@query("junction_decomposition", f"WITH j AS (SELECT gene, unnest(list_distinct(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || '-' || x[2]))) AS junction FROM {_S} WHERE len(t) > 1), c AS (SELECT o_custkey AS gene, count(*) AS n FROM orders GROUP BY 1) SELECT junction, CAST(sum(n) AS BIGINT) AS reads, count(*) AS isoforms FROM j JOIN c USING (gene) GROUP BY 1")
def junction_decomposition_query(s, d):
    n = A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("gene")).agg(F.count("*").alias("n"))
    return junction_decomposition(structures(s, d).join(n, "gene"), "t", "n")


@query("gene_model_segments", f"""WITH b AS (SELECT DISTINCT chrom, unnest([start, "end"]) AS x FROM {INTERVALS}), s AS (SELECT chrom, x AS start, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS e FROM b),
v AS (SELECT chrom, x, sum(sum(d)) OVER (PARTITION BY chrom ORDER BY x) AS depth FROM (SELECT chrom, start AS x, 1 AS d FROM {INTERVALS} UNION ALL SELECT chrom, "end", -1 FROM {INTERVALS}) GROUP BY 1, 2),
k AS (SELECT s.chrom, s.start, s.e, depth > 0 AS exon FROM s JOIN v ON v.chrom = s.chrom AND v.x = s.start WHERE s.e IS NOT NULL),
n AS (SELECT *, exon AND NOT coalesce(lag(exon) OVER (PARTITION BY chrom ORDER BY start), false) AS opens FROM k), m AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS block FROM n)
SELECT chrom, start, e AS "end", (CASE WHEN exon THEN 'E' ELSE 'I' END) || block || '.' || row_number() OVER (PARTITION BY chrom, block, exon ORDER BY start) AS name FROM m""")
def gene_model_segments(s, d):
    return gene_model(A.intervals(s, d), "chrom")


@query("token_frequency", f"SELECT lang, t AS token, count(*) AS n FROM (SELECT lang, unnest(tokens) AS t FROM {TOKENS}) GROUP BY 1, 2 HAVING count(*) >= 50")
def token_frequency(s, d):
    return A.tokens(s, d).select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n")).filter("n >= 50")


@query("props_json", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def props_json(s, d):
    return A.table(s, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("reverse_complement", "SELECT s_suppkey, reverse(translate(upper(substr(translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12)), 'ACGT', 'TGCA')) || '-1' AS barcode FROM supplier")
def reverse_complement(s, d):
    nt = F.substring(F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 12)
    return A.table(s, d, "supplier").select("s_suppkey", X.reverse_complement(F.concat(nt, F.lit("-1"))).alias("barcode"))


@query("geometric_mean", "SELECT o_custkey AS gene, round(CASE WHEN min(o_totalprice - 5000) <= 0 THEN 0 ELSE exp(avg(ln(greatest(o_totalprice - 5000, 1e-9)))) END, 4) AS m FROM orders GROUP BY 1")
def geometric_mean(s, d):
    t = A.table(s, d, "orders").select(F.col("o_custkey").alias("gene"), (F.col("o_totalprice") - 5000).alias("v"))
    return t.groupBy("gene").agg(F.round(X.geometric_mean_of("v"), 4).alias("m"))


@query("redundant_sequences", "SELECT text_hash, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def redundant_sequences(s, d):
    t = A.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return t.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
