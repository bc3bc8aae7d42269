"""Containment of structures against all pairs."""

import random

from exonloom.operators import structures
from exonloom.plans import registry
from exonloom.sources import shared


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = {(g, "|".join(f"E{rng.randint(1, 3)}.{rng.randint(1, 2)}" for _ in range(rng.randint(1, 6)))) for g in (1, 2, None) for _ in range(40)}
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and f"|{a}|" in f"|{b}|"}
    found = structures._contained(spark.createDataFrame(sorted(rows, key=repr), "gene int, core string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # pairs meet on a whole part, not on one token that most structures of a gene hold
    assert "_t#" not in found._jdf.queryExecution().executedPlan().toString()


def test_collapses_broadcast_nothing(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(c, c % 2) for c in range(60)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 60) for k in range(300)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    plans = []
    monkeypatch.setattr(structures, "cut", lambda df: plans.append(df) or shared.cut(df))
    for name in ("core_collapse", "substring_collapse"):
        plans.append(registry.queries()[name](spark, str(tmp_path)))
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]
