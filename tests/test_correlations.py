"""Correlations by blocks against one pair at a time."""

import math
import random

import pytest

from exonloom.operators import stats
from exonloom.plans import registry


def by_hand(values, least):
    by = {}
    for f, s, v in values:
        by.setdefault(f, {})[s] = v
    out = {}
    for x in by:
        for y in by:
            both = sorted(by[x].keys() & by[y].keys())
            if x < y and len(both) >= least:
                p, q = [by[x][s] for s in both], [by[y][s] for s in both]
                p, q = [a - sum(p) / len(p) for a in p], [a - sum(q) / len(q) for a in q]
                under = math.sqrt(sum(a * a for a in p) * sum(b * b for b in q))
                out[x, y] = (len(both), sum(a * b for a, b in zip(p, q)) / under if under > 1e-12 else None)
    return out


def test_blocks_equal_single_pairs(spark, monkeypatch):
    monkeypatch.setattr(stats, "DENSE", 64)  # blocks of 64 features
    rng = random.Random(3)
    values = [(f, f"s{s}", 5.0 if f % 9 == 0 else float(rng.choice([1, 2, 3, 50]))) for f in range(150) for s in range(7) if rng.random() < 0.8]
    df = spark.createDataFrame(values, "gene int, donor string, v double")
    want = by_hand(values, 3)
    got = {(r.x, r.y): (r.n, r.r) for r in stats.correlated_pairs(df, "gene", "donor", "v", 3).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == (r if r is None else pytest.approx(r, abs=1e-9)) for k, (n, r) in want.items())
    near = lambda k: (-round(abs(want[k][1]), 9) if want[k][1] is not None else 1, k[1])
    best = {k for x in range(150) for k in sorted((k for k in want if k[0] == x), key=near)[:2]}
    pairs = stats.correlated_pairs(df, "gene", "donor", "v", 3, top=2)
    assert {(r.x, r.y) for r in pairs.collect()} == best
    over = [k for k, (_, r) in want.items() if r is not None and r > 0.1]
    n = {r.gene: r.n for r in stats.correlated_partners(df, "gene", "donor", "v", 3, 0.1).collect()}
    assert n == {f: c for f in range(150) if (c := sum(f in k for k in over))}
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()  # no table of pairs and samples


def test_intercorrelated_features_reads_its_whole_table(spark, tmp_path):
    # genes that 4 doesn't divide, and counts of 20 or less
    spark.createDataFrame([(c, c, "A", 1.0) for c in range(4)], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(c, c) for c in range(4)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, g, float(g + c)) for c in range(4) for g in (1, 2, 3, 5)], "l_orderkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["intercorrelated_features"](spark, str(tmp_path)).collect()
    assert {(r.gene, r.partners) for r in got} == {(g, 4) for g in (1, 2, 3, 5)}
