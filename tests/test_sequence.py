"""Sequence functions on cases worked out by hand."""

from exonloom.functions import sequence as S


def test_translation_and_frames():
    assert len(S.CODON) == 64 and S.translated("ATGGCCTAAxx") == "MA*" and S.translated("ANG") == "X"
    assert S.longest_orf("CATGAAATAGATGTAA") == (1, 10)
    assert S.longest_orf("CATGAAATAGATGTAA", (10,)) == (10, 16)
    assert S.longest_orf("CCC") == (-1, -1) and S.longest_orf("ATGAAA") == (-1, -1)
    assert S.decays(10, 100) and not S.decays(80, 100) and not S.decays(-1, 100)


def test_junction_peptides():
    words = S.junction_peptides("ATGGCC", "AAAGGG", 2)
    assert "AK" in words and "MA" not in words and "KG" not in words
    assert all(len(w) == 2 for w in words)
    assert S.junction_peptides("TAATAA", "TAATAA", 2) != ["**"]


def test_domains_and_names():
    assert S.covered([(0, 10), (20, 30)], [(5, 25)]) == 0.5 and S.covered([], [(0, 1)]) == 0
    assert S.termini_changed("MAAAAK", "MAAAAR") == (False, True)
    assert {S.hla_name(x) for x in ("A0201", "A*02:01", "HLA-A02:01", "hla-a*02:01:01")} == {"HLA-A*02:01"}
    assert S.hla_name("DRB1*15:01") == "HLA-DRB1*15:01" and S.hla_name("odd") == "odd"


def test_farthest_points():
    sets = [frozenset({1, 2}), frozenset({1, 2, 3}), frozenset({9}), frozenset({2, 9})]
    assert S.farthest_points(sets, 3) == [0, 2, 3] and S.farthest_points([], 2) == []


def test_udfs(spark):
    r = spark.createDataFrame([("ATGGCCTAA",), (None,)], "x string").select(S.translate_udf("x").alias("p"), S.longest_orf_udf("x").alias("o")).collect()
    assert [(x.p, tuple(x.o)) for x in r] == [("MA*", (0, 9)), (None, (-1, -1))]
