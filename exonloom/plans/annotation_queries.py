"""Queries on names and classes, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators import annotation as N
from exonloom.operators.tokens import adjacent
from exonloom.plans.registry import query
from exonloom.plans.token_queries import _S, structures
from exonloom.sources import adapters as A

_FEATURE = """(SELECT o_orderkey AS k, 'G' || (o_custkey % 50) || ':E' || (o_orderkey % 9 + 1) || '.1-E' || (o_orderkey % 7 + 2) || '.1' AS name,
o_orderkey AS s, o_custkey * 3 AS e, 'chr' || (o_orderkey % 22 + 1) AS c FROM orders)"""


def features(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    name = F.concat(F.lit("G"), text(c % 50), F.lit(":E"), text(k % 9 + 1), F.lit(".1-E"), text(k % 7 + 2), F.lit(".1"))
    return A.table(s, d, "orders").select(k.alias("k"), F.concat(name, F.lit("=chr"), text(k % 22 + 1), F.lit(":"), text(k), F.lit("-"), text(c * 3)).alias("feature"))


@query("junction_features", f"""SELECT k, name || '=' || c || ':' || s || '-' || e AS feature, split_part(name, ':', 1) AS gene, c AS chrom, s AS start,
e AS "end", CASE WHEN s < e THEN '+' ELSE '-' END AS strand FROM {_FEATURE}""")
def junction_features(s, d):
    return features(s, d).select("k", "feature", *(v.alias(n) for n, v in N.junction_feature(F.col("feature")).items()))


_JUNCTION = """(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'bare' WHEN o_orderkey % 10 = 1 THEN 'G1:E1.1' WHEN o_orderkey % 10 < 5
THEN 'G' || o_custkey || ':E1.' || (o_orderkey % 4) || '-G' || (o_custkey + 1) || ':E2.1' ELSE 'G' || o_custkey || ':E1.' || (o_orderkey % 4) || '-E2.1' END AS j,
o_custkey AS c FROM orders)"""


@query("junction_genes", f"""SELECT k, j, CASE WHEN k % 10 > 1 THEN 'G' || c END AS gene1, CASE WHEN k % 10 > 1 THEN 'E1.' || (k % 4) END AS exon1,
CASE WHEN k % 10 > 1 THEN 'G' || CASE WHEN k % 10 < 5 THEN c + 1 ELSE c END END AS gene2, CASE WHEN k % 10 > 1 THEN 'E2.1' END AS exon2 FROM {_JUNCTION}""")
def junction_genes(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    left = F.concat(F.lit("G"), text(c), F.lit(":E1."), text(k % 4))
    two = F.concat(left, F.lit("-G"), text(c + 1), F.lit(":E2.1"))
    j = F.when(k % 10 == 0, "bare").when(k % 10 == 1, "G1:E1.1").when(k % 10 < 5, two).otherwise(F.concat(left, F.lit("-E2.1")))
    t = A.table(s, d, "orders").select(k.alias("k"), j.alias("j"))
    return t.select("k", "j", *(v.alias(n) for n, v in N.junction_exons(F.col("j")).items()))


_SYMBOLS = "['RPL', 'Rps', 'MT-', 'AC0.', 'Gm', 'XIST', 'TSIX', 'HLA-', 'UTY', 'GATA', 'SRSF', 'KDM5Y']"
_GENES = f"""(SELECT p_partkey AS gene, {_SYMBOLS}[p_partkey % 12 + 1] || CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS symbol,
CASE WHEN p_size % 5 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS biotype,
['cellcycle', 'ribosome', 'mitochondrial', 'antisense', 'predict_gene', 'other'][p_size % 6 + 1] AS class FROM part)"""


def genes(s, d):
    k = F.col("p_partkey")
    names = ["RPL", "Rps", "MT-", "AC0.", "Gm", "XIST", "TSIX", "HLA-", "UTY", "GATA", "SRSF", "KDM5Y"]
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    classes = ["cellcycle", "ribosome", "mitochondrial", "antisense", "predict_gene", "other"]
    return A.table(s, d, "part").select(
        k.alias("gene"),
        F.concat(of(names, k % 12), F.when(k % 3 > 0, k.cast("string")).otherwise("")).alias("symbol"),
        F.when(F.col("p_size") % 5 == 0, "lncRNA").otherwise("protein_coding").alias("biotype"),
        of(classes, F.col("p_size") % 6).alias("class"),
    )


@query("nuisance_genes", f"""SELECT gene, symbol FROM {_GENES} WHERE biotype = 'protein_coding' AND NOT (starts_with(upper(symbol), 'RPL') OR starts_with(upper(symbol), 'RPS')
OR starts_with(upper(symbol), 'MT-') OR contains(symbol, '.') OR starts_with(upper(symbol), 'GM') OR starts_with(upper(symbol), 'XIS') OR starts_with(upper(symbol), 'TSI')
OR starts_with(upper(symbol), 'RSP') OR starts_with(upper(symbol), 'HLA') OR ends_with(upper(symbol), 'Y'))""")
def nuisance_genes(s, d):
    return N.without_nuisance(genes(s, d), "symbol", "biotype").select("gene", "symbol")


@query("program_genes", f"""SELECT gene, symbol FROM {_GENES} WHERE biotype = 'protein_coding' AND upper(symbol) NOT IN ('XIST', 'TSIX')
AND NOT starts_with(upper(symbol), 'RPL') AND NOT starts_with(upper(symbol), 'RPS')""")
def program_genes(s, d):
    return N.without_nuisance(genes(s, d), "symbol", "biotype", N.UDON_NUISANCE).select("gene", "symbol")


@query("artifact_purge", " UNION ALL ".join(f"""SELECT {k} AS criterion, gene FROM {_GENES} WHERE gene % 7 < 5 AND gene NOT IN
(SELECT gene FROM {_GENES} WHERE gene % 4 = 0 AND class NOT IN ({', '.join(f"'{c}'" for c in v) or "''"}))""" for k, v in N.SPARED.items()))
def artifact_purge(s, d):
    g = genes(s, d)
    mine, artifacts = g.filter("gene % 7 < 5").select("gene"), g.filter("gene % 4 = 0").select("gene", "class")
    out = [N.without_artifacts(mine, artifacts, k).select(F.lit(k).alias("criterion"), "gene") for k in N.SPARED]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


_J = f"""(SELECT DISTINCT gene, t[i] AS e1, t[i + 1] || CASE WHEN gene % 13 = 0 THEN '_9' ELSE '' END AS e2
FROM (SELECT gene, t, unnest(generate_series(1, len(t) - 1)) AS i FROM {_S} WHERE len(t) > 1))"""


@query("undocumented_junctions", f"""SELECT j.gene, j.e1, j.e2 FROM {_J} j WHERE contains(e2, '_') OR NOT EXISTS
(SELECT 1 FROM {_J} k WHERE k.gene % 3 = 0 AND k.gene // 6 = j.gene // 6 AND k.e1 = j.e1 AND k.e2 = j.e2 AND k.gene % 13 != 0)""")
def undocumented_junctions(s, d):
    t = structures(s, d).filter("size(t) > 1")
    j = t.select("gene", F.explode(F.array_distinct(adjacent(F.col("t")))).alias("p")).select("gene", F.split_part("p", F.lit("-"), F.lit(1)).alias("e1"), F.split_part("p", F.lit("-"), F.lit(2)).alias("e2"))
    j = j.withColumns({"e2": F.concat("e2", F.when(F.col("gene") % 13 == 0, "_9").otherwise("")), "own": F.col("gene"), "gene": F.expr("gene div 6")})
    known = t.filter("gene % 3 = 0 and gene % 13 != 0").select(F.expr("gene div 6").alias("gene"), F.col("t").alias("tokens"))
    return N.undocumented(j, known).select(F.col("own").alias("gene"), "e1", "e2")


_N = f"(SELECT gene, list_transform(t, lambda x, i: CASE WHEN (gene + i) % 4 = 0 THEN x || '_77' WHEN (gene + i) % 7 = 0 THEN 'U' || x[2:] ELSE x END) AS t FROM {_S})"


def novel_tokens(s, d):
    token = lambda x, i: F.when((F.col("gene") + i + 1) % 4 == 0, F.concat(x, F.lit("_77"))).when((F.col("gene") + i + 1) % 7 == 0, F.concat(F.lit("U"), F.substring(x, 2, 100))).otherwise(x)
    return structures(s, d).select("gene", F.transform("t", token).alias("t"))


@query("terminal_trim", f"""SELECT gene, array_to_string(list_filter(t, lambda x, i: NOT ((i = 1 OR i = len(t)) AND x[1] = 'E' AND contains(x, '_'))), '|') AS tokens FROM {_N}""")
def terminal_trim(s, d):
    return novel_tokens(s, d).select("gene", F.array_join(N.without_novel_ends(F.col("t")), "|").alias("tokens"))


@query("annotated_token_filter", f"SELECT gene, array_to_string(list_filter(t, lambda x: x[1] = 'E' AND NOT contains(x, '_')), '|') AS tokens FROM {_N}")
def annotated_token_filter(s, d):
    return novel_tokens(s, d).select("gene", F.array_join(N.annotated_tokens(F.col("t")), "|").alias("tokens"))


_REG = """(SELECT o_custkey AS gene, o_orderkey AS start, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderkey + 200) AS "end",
CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'I' END || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '.1' AS region,
CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders))"""
_SITE = "(SELECT DISTINCT o_custkey AS gene, o_orderkey + (o_orderkey * 37) % 500 - 150 AS pos FROM orders)"


@query("site_naming", f"""WITH r AS (SELECT *, row_number() OVER w AS n, lag(region) OVER w AS before, lead(region) OVER w AS after FROM {_REG}
WINDOW w AS (PARTITION BY gene ORDER BY CASE WHEN strand = '+' THEN start ELSE -"end" END)),
b AS (SELECT gene, min(start) AS low, max("end") AS high, arg_max(region, n) AS last, any_value(strand) AS strand FROM r GROUP BY 1),
h AS (SELECT s.gene, s.pos, arg_min(CASE WHEN region[1] = 'I' AND ends_with(region, '.1') AND CASE WHEN strand = '+' THEN pos - start ELSE "end" - pos END < 50 THEN coalesce(before, region)
WHEN region[1] = 'I' AND ends_with(region, '.1') AND CASE WHEN strand = '+' THEN "end" - pos ELSE pos - start END < 50 THEN coalesce(after, region) ELSE region END, n) AS region
FROM {_SITE} s JOIN r ON r.gene = s.gene AND pos BETWEEN start AND "end" GROUP BY 1, 2)
SELECT s.gene, s.pos, CASE WHEN (b.strand = '+' AND s.pos < low) OR (b.strand = '-' AND s.pos > high) THEN 'U1.1'
ELSE coalesce(h.region, 'U' || (CAST(regexp_extract(last, '^.([0-9]+)', 1) AS INTEGER) + 1) || '.1') END || '_' || s.pos AS name
FROM {_SITE} s JOIN b USING (gene) LEFT JOIN h ON h.gene = s.gene AND h.pos = s.pos""")
def site_naming(s, d):
    k = F.col("o_orderkey")
    o = A.table(s, d, "orders").select("o_custkey", "o_orderkey").distinct()
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "E").otherwise("I"), F.row_number().over(w).cast("string"), F.lit(".1"))
    regions = o.select(F.col("o_custkey").alias("gene"), k.alias("start"), F.coalesce(F.lead(k).over(w) - 1, k + 200).alias("end"), name.alias("region"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    sites = o.select(F.col("o_custkey").alias("gene"), (k + k * 37 % 500 - 150).alias("pos")).distinct()
    return N.site_names(sites, regions)


@query("proximity_inversion", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'proximal' WHEN 1 THEN 'distal' WHEN 2 THEN 'inclusion' WHEN 3 THEN 'exclusion' ELSE 'none' END AS label,
CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'distal' WHEN 1 THEN 'proximal' WHEN 2 THEN 'exclusion' WHEN 3 THEN 'inclusion' ELSE 'none' END
ELSE CASE o_orderkey % 5 WHEN 0 THEN 'proximal' WHEN 1 THEN 'distal' WHEN 2 THEN 'inclusion' WHEN 3 THEN 'exclusion' ELSE 'none' END END AS turned FROM orders""")
def proximity_inversion(s, d):
    k = F.col("o_orderkey") % 5
    label = F.when(k == 0, "proximal").when(k == 1, "distal").when(k == 2, "inclusion").when(k == 3, "exclusion").otherwise("none")
    t = A.table(s, d, "orders").select("o_orderkey", label.alias("label"), F.when(F.col("o_custkey") % 2 == 0, -1).otherwise(1).alias("sign"))
    return t.select("o_orderkey", "label", N.by_sign(F.col("label"), F.col("sign")).alias("turned"))


@query("complex_members", "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ['+', ' | ', ';,', ''][p_partkey % 4 + 1] || p_brand, '[+|;,]'), lambda x: trim(x)), lambda x: x != ''), '/') AS members FROM part")
def complex_members(s, d):
    between = F.element_at(F.array(*map(F.lit, ["+", " | ", ";,", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return A.table(s, d, "part").select("p_partkey", F.array_join(N.members(F.concat("p_name", between, "p_brand")), "/").alias("members"))


@query("strand_resolution", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END
WHEN l_orderkey % 3 = 1 THEN CASE WHEN (l_partkey % 5 < 2) != (l_linestatus = 'F') THEN '+' ELSE '-' END
WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END ELSE '.' END AS strand FROM lineitem""")
def strand_resolution(s, d):
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    sign = lambda c: F.when(c, "+").otherwise("-")
    strand = N.read_strand(F.when(k % 3 == 0, sign(p % 2 == 0)), F.when(k % 3 == 1, sign(p % 5 < 2)), F.col("l_linestatus") == "F", F.col("l_returnflag") == "R")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", strand.alias("strand"))


_XS = "CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END END"
_ST = "CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END"


@query("strand_guard", f"""SELECT l_suppkey AS intron, count(*) FILTER ({_XS} IS NULL OR {_XS} = {_ST}) AS auto, count(*) FILTER ({_ST} = '+' AND l_linestatus = 'O') AS forward,
count(*) FILTER ({_ST} = '-' AND l_linestatus = 'F') AS reverse, count(*) AS unstranded FROM lineitem GROUP BY 1""")
def strand_guard(s, d):
    sign = lambda c: F.when(c, "+").otherwise("-")
    xs, own = F.when(F.col("l_orderkey") % 3 == 0, sign(F.col("l_partkey") % 2 == 0)), sign(F.col("l_suppkey") % 2 == 0)
    modes = ("auto", "forward", "reverse", "unstranded")
    return A.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("intron")).agg(*(F.count_if(N.strand_allows(m, xs, own, sign(F.col("l_linestatus") == "O"))).alias(m) for m in modes))


_HGVS = "['c.487_488ins', 'c.377delA', 'c.1992_1994delATTinsGGA', 'p.G643fs', 'c.516A>C', 'c.22dup', NULL]"


@query("indel_classes", f"SELECT p_partkey, {_HGVS}[p_partkey % 7 + 1] AS label, ['ins', 'del', 'any', 'any', NULL, 'ins', NULL][p_partkey % 7 + 1] AS class FROM part")
def indel_classes(s, d):
    labels = ["c.487_488ins", "c.377delA", "c.1992_1994delATTinsGGA", "p.G643fs", "c.516A>C", "c.22dup", None]
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return A.table(s, d, "part").select("p_partkey", label.alias("label")).withColumn("class", N.indel_class(F.col("label")))


@query("arm_labels", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'chr' || (o_custkey % 7) || CASE WHEN o_orderkey * 100 < (o_custkey % 7) * 200000 THEN 'p' ELSE 'q' END END AS arm FROM orders""")
def arm_labels(s, d):
    c = F.col("o_custkey") % 7
    t = A.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("chr"), c.cast("string")).alias("chrom"), F.when(c > 0, c * 200_000).alias("centromere"))
    return t.select("o_orderkey", N.arm("chrom", F.col("o_orderkey") * 100, F.col("centromere")).alias("arm"))


@query("protein_change", """SELECT p_partkey, '(' || CASE WHEN p_size = p_partkey % 50 THEN '~' WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END || ')AA:' || p_size || '(' || p_brand || '-PEP)->' || (p_partkey % 50) || '(' || p_type || ')' AS change FROM part""")
def protein_change(s, d):
    k = F.col("p_partkey")
    text = N.length_change(F.col("p_size"), k % 50, F.concat("p_brand", F.lit("-PEP")), F.col("p_type"), F.when(k % 2 == 0, "+").otherwise("-"))
    return A.table(s, d, "part").select("p_partkey", text.alias("change"))


_EV = """(SELECT o_orderkey AS k, 'G' || (o_custkey % 3) || ':' || ['E1.1', 'E10.1', 'E4.1', 'I3.1', 'E4.2_55', 'E5.1'][o_orderkey % 6 + 1] || '-' || ['E5.1', 'E6.2', 'E6.1'][o_orderkey % 3 + 1] AS a,
'G' || (o_custkey % 2) || ':' || ['E4.1', 'E4.2', 'I3.1_9', 'E5.1', 'E10.2'][o_orderkey % 5 + 1] || '-' || ['E6.1', 'E7.1'][o_orderkey % 2 + 1] AS b, '1-' || (o_orderkey % 4) AS c, '2-9' AS e FROM orders)"""


@query("summary_events", f"""WITH x AS (SELECT *, split_part(a, ':', 1) AS ga, split_part(b, ':', 1) AS gb, string_split(split_part(a, ':', 2), '-') AS pa, string_split(split_part(b, ':', 2), '-') AS pb FROM {_EV})
SELECT k, CASE WHEN starts_with(pa[1], 'E1.') OR starts_with(pb[1], 'E1.') THEN 'Alternative Promoter'
WHEN contains(a, '_') AND contains(b, '_') AND split_part(a, '_', 1) = split_part(b, '_', 1) THEN 'Alternative Polyadenylation' WHEN ga != gb THEN 'Trans-Splicing'
WHEN (contains(a, 'I') OR contains(b, 'I')) AND NOT contains(a, '_') AND NOT contains(b, '_') AND abs(CAST(split_part(c, '-', 2) AS INTEGER) - 2) = 1 THEN 'Intron Retention'
WHEN (contains(a, 'I') OR contains(b, 'I')) AND (contains(a, '_') OR contains(b, '_')) THEN 'Novel Cassette Exon'
WHEN split_part(pa[1], '.', 1) = split_part(pb[1], '.', 1) AND pa[1] != pb[1] THEN 'Alternative 5'' Splice Site'
WHEN split_part(pa[2], '.', 1) = split_part(pb[2], '.', 1) AND pa[2] != pb[2] THEN 'Alternative 3'' Splice Site' END AS event FROM x""")
def summary_events(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    a = F.concat(F.lit("G"), (c % 3).cast("string"), F.lit(":"), of(["E1.1", "E10.1", "E4.1", "I3.1", "E4.2_55", "E5.1"], k % 6), F.lit("-"), of(["E5.1", "E6.2", "E6.1"], k % 3))
    b = F.concat(F.lit("G"), (c % 2).cast("string"), F.lit(":"), of(["E4.1", "E4.2", "I3.1_9", "E5.1", "E10.2"], k % 5), F.lit("-"), of(["E6.1", "E7.1"], k % 2))
    t = A.table(s, d, "orders").select(k.alias("k"), a.alias("a"), b.alias("b"), F.concat(F.lit("1-"), (k % 4).cast("string")).alias("c"))
    return t.select("k", N.summary_event(F.col("a"), F.col("b"), F.col("c"), F.lit("2-9")).alias("event"))
