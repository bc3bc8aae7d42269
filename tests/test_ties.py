"""Cases in which queries differed from their SQL on larger tables."""

import math
import random

from pyspark.sql import functions as F

from exonloom.functions import special
from exonloom.operators import networks, ranking, selection, tumour


def test_arm_calls_take_the_smaller_of_equal_ratios(spark):
    # 2.25 lies in the middle of 2.0 and 2.5; sums in another order come out a last bit over it
    rows = [("g", "a", 2.25 + 1e-13), ("h", "a", 0.75), ("i", "a", 1.75)]
    bins = spark.createDataFrame(rows, "gene string, arm string, v double")
    r = {x.gene: x.ratio for x in tumour.arm_calls(bins, "gene", "arm", "v", 0.5, 3, [0.5, 1.0, 1.5, 2.0, 2.5]).collect()}
    assert r == {"g": 2.0, "h": 1.0, "i": 1.0}


def test_copy_state_takes_the_smaller_of_equal_ratios(spark):
    v = spark.createDataFrame([("g", 1.75 + 1e-15), ("h", 1.25 + 1e-15)], "gene string, x double")
    assert {r.gene: r.copies for r in networks.copy_state(v, ["gene"], "x", [0.5, 1.0, 1.5, 2.0], 0.25).collect()} == {"g": 1.5, "h": 1.0}


def test_tail_of_an_impossible_draw_is_no_evidence():
    assert special.hypergeometric_sf(3, 10, 12, 5) == special.hypergeometric_sf(3, 10, 5, 12) == 1.0
    assert special.hypergeometric_sf(3, 10, 3, 10) == 1.0


def test_t_tail_keeps_its_digits_near_one():
    # 1 - 2 * density(0) * |t|; df / (df + t^2) alone rounds to 1
    for df in (4, 600, 4000):
        top = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (1e-9, 1e-7, 3e-5):
            assert abs(special.t_two_sided(t, df) - (1 - 2 * top * t)) < 1e-13


def test_q_is_found_though_p_comes_out_otherwise_when_computed_again(spark):
    p = F.udf(lambda _: random.random(), "double").asNondeterministic()
    df = spark.range(50).repartition(4).withColumn("p", p("id"))
    assert sum(r.q is not None for r in ranking.with_q(df, [], "p", ["id"]).collect()) == 50


def test_a_barcode_labelled_twice_gives_both_rows(spark):
    cells = spark.createDataFrame([("AACC-1", 1), ("ACGA-1", 2)], "barcode string, ord bigint")
    labels = spark.createDataFrame([("AACC-1", "x", 1), ("AACC-1", "y", 2), ("ACGA-1", "x", 3)], "barcode string, label string, ord bigint")
    assert sorted(map(tuple, selection.joined_barcodes(cells, labels).collect())) == [("AACC-1", 1, "x"), ("AACC-1", 1, "y"), ("ACGA-1", 2, "x")]


def test_cells_that_add_up_to_zero_count(spark):
    m = spark.createDataFrame([("a", 1, -1.5), ("a", 2, 1.5), ("b", 1, 0.5), ("b", 2, -0.5), ("c", 1, 0.0)], "cell string, gene int, value double")
    assert [(r.status, r.cells) for r in selection.scaling_status(m, None, 0).collect()] == [("prescaled", 2)]
