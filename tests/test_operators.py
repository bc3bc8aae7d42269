"""Hand-computed cases: tails, tokens, CIGAR strings, runs, intervals, collapse, graphs."""

import math

import pytest
from pyspark.sql import functions as F

from exonloom.functions import special as P
from exonloom.operators import graphs, joins, ranking, runs, splicing, structures, tokens


def test_tails():
    assert P.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert P.chi2_1_sf(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert P.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert P.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert P.hypergeometric_sf(0, 20, 5, 5) == pytest.approx(1.0)
    assert P.hypergeometric_sf(5, 10, 5, 5) == pytest.approx(1 / math.comb(10, 5))
    assert P.binomial_sf(2, 3, 0.5) == pytest.approx(0.5)
    assert P.binomial_sf(0, 3, 0.1) == 1 and P.binomial_sf(4, 3, 0.1) == 0
    assert P.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert P.normal_sf(30) == pytest.approx(4.906713927148187e-198, rel=1e-9)


def test_udf_passes_nulls(spark):
    got = spark.createDataFrame([(0.0,), (None,)], "z double").select(P.as_udf(P.normal_sf)("z").alias("p")).collect()
    assert [r.p for r in got] == [0.5, None]


def test_psi_of_touching_and_overlapping_junctions(spark):
    j = spark.createDataFrame([("g", 0, 10, "s", 4), ("g", 10, 20, "s", 6), ("g", 5, 12, "s", 2), ("h", 0, 10, "s", 9)], "gene string, start bigint, end bigint, sample string, count bigint")
    got = {(r.gene, r.start): (r.inclusion, r.clique, r.psi) for r in splicing.psi(j, 5).collect()}
    assert got == {("g", 0): (4, 6, 4 / 6), ("g", 10): (6, 8, 6 / 8), ("g", 5): (2, 12, 2 / 12), ("h", 0): (9, 9, 1.0)}
    low = {(r.gene, r.start): r.psi for r in splicing.psi(j, 9).collect()}
    assert low[("g", 0)] is None and low[("h", 0)] == 1.0


def test_tokens(spark):
    row = spark.createDataFrame([(["E1.1", "E1.2", "I1.1", "E2.1_77", "E2.1_77"], "5M2I10N3M", "ACG-1", "12.5", "-1", "1e3")], "t array<string>, c string, b string, x string, y string, z string")
    c = F.col
    r = row.select(
        tokens.blocks(c("t")).alias("blocks"), tokens.regions(c("t")).alias("regions"), tokens.deduped(c("t")).alias("d"), tokens.adjacent(c("t")).alias("a"), tokens.cigar_blocks(c("c"), F.lit(100)).alias("k"),
        tokens.reverse_complement(c("b")).alias("b"), *(tokens.numeric_or_null(c(x)).alias(x) for x in "xyz"), tokens.without_version(F.lit("ENSG0001.7")).alias("v"),
    ).first()
    assert (r.blocks, r.regions, r.d) == (2, 3, ["E1.1", "E1.2", "I1.1", "E2.1_77"])
    assert r.a == ["E1.1-E1.2", "E1.2-I1.1", "I1.1-E2.1_77", "E2.1_77-E2.1_77"]
    assert [(b.start, b.end) for b in r.k] == [(100, 105), (115, 118)]
    assert (r.b, r.x, r.y, r.z, r.v) == ("CGT-1", 12.5, None, None, "ENSG0001")


def test_runs_and_windows(spark):
    df = spark.createDataFrame([("c", k, float(v)) for k, v in enumerate([0, 5, 6, 7, 0, 9, 9, 0])], "chrom string, pos bigint, value double")
    assert sorted(map(tuple, runs.runs(df, ["chrom"], "pos", F.col("value") > 4, 3).collect())) == [("c", 1, 3, 3)]
    assert [tuple(r) for r in runs.hysteresis(df, ["chrom"], "pos", "value", 4, 8, 2).collect()] == [("c", 5, 6, 2, 9.0)]
    w = sorted(tuple(r) for r in runs.gene_windows(df, "chrom", "pos", "value", 4, 3).collect())
    assert [(r[1], r[2]) for r in w] == [(0, 4), (3, 4), (4, 4)]
    assert runs.gene_windows(df, "chrom", "pos", "value", 9, 3).count() == 0


def test_intervals(spark):
    i = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 30, 40), ("c", 35, 36)], "chrom string, start bigint, end bigint")
    assert sorted(map(tuple, runs.merged_intervals(i, "chrom").collect())) == [("c", 0, 20, 2), ("c", 30, 40, 2)]
    assert sorted(map(tuple, runs.coverage_runs(i, "chrom", 2).collect())) == [("c", 35, 36)]
    p = spark.createDataFrame([("c", 10), ("c", 25), ("d", 1)], "chrom string, pos bigint")
    spans = i.withColumns({"gene": F.col("start"), "rank": -F.col("start")})
    got = {(r.chrom, r.pos): r.gene for r in joins.point_in_interval(p, spans, ["chrom"], "pos", 16, "gene", "rank").collect()}
    assert got == {("c", 10): 10, ("c", 25): None, ("d", 1): None}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03, None, 0.5])], "k int, p double")
    q = {r.k: r.q for r in ranking.with_q(df, [], "p", ["k"]).collect()}
    assert q[3] is None and [round(q[k], 6) for k in (0, 1, 2, 4)] == [0.04, 0.053333, 0.053333, 0.5]


def test_collapse_and_em(spark):
    s = spark.createDataFrame([("g", "E1|E2|E3", 5, True), ("g", "E2|E3", 3, False), ("g", "E1|E3", 2, False), ("g", "E2", 1, True)], "gene string, structure string, reads bigint, is_ref boolean")
    assert {r.structure: r.parent for r in structures.collapse(s).collect()} == {"E1|E2|E3": "E1|E2|E3", "E2|E3": "E1|E2|E3", "E1|E3": "E1|E3", "E2": "E2"}
    e = spark.createDataFrame([("g", "a", "x", 8), ("g", "b", "x", 4), ("g", "b", "y", 4)], "gene string, read_class string, isoform string, reads bigint")
    share = {r.isoform: r.share for r in structures.em_shares(e).collect()}
    assert share["x"] > 0.95 and sum(share.values()) == pytest.approx(1)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "parent int, child int")
    assert sorted(map(tuple, graphs.closure(e).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1), (2, 4, 2), (3, 4, 1)]
    r = graphs.pagerank(e.toDF("source", "target"), 30)
    assert r.agg(F.sum("rank")).first()[0] == pytest.approx(1) and r.orderBy(F.desc("rank")).first().node == 4
