"""Models against their defining equations."""

import pathlib

import numpy as np
import pandas as pd
import pytest

from exonloom.operators import models as M


def test_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2)) + 3
    y = x @ [2.0, -1.0] + 5
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    w, b = M.ridge_normal(df, ["a", "b"], "y", 1e-9)
    assert np.allclose(w, [2, -1], atol=1e-5) and b == pytest.approx(5, abs=1e-4)


def test_elastic_net_is_stationary():
    rng = np.random.default_rng(1)
    x, alpha, l1 = rng.normal(size=(80, 4)), 0.1, 0.5
    y = x @ [1.0, 0, -2, 0.01] + 1
    w, b = M.elastic_net(x, y, alpha, l1)
    g = x.T @ (x @ w + b - y) / 80 + alpha * (1 - l1) * w
    assert all(abs(g[j] + alpha * l1 * np.sign(w[j])) < 1e-6 if w[j] else abs(g[j]) <= alpha * l1 + 1e-6 for j in range(4))


def test_nnls():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=(12, 5)), rng.normal(size=12)
        x = M.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g >= -1e-8).all() and abs(g @ x) < 1e-8


def test_cox():
    time, event, x = np.array([1.0, 2, 3, 4, 5, 6]), np.array([1, 1, 0, 1, 1, 1]), np.array([1.0, 0, 1, 0, 1, 0])
    b, se = M.cox_slope(time, event, x)

    def loss(v):
        return -sum(v * x[i] - np.log(np.exp(v * x[time >= time[i]]).sum()) for i in range(6) if event[i])

    assert loss(b) <= min(loss(b + 1e-3), loss(b - 1e-3)) and se > 0


def test_running_sum_and_nmf():
    s = np.array([4.0, 3, 2, 1])
    assert M.running_sum(s, np.array([1, 1, 0, 0], bool)) == pytest.approx(1)
    assert M.running_sum(s, np.array([0, 0, 1, 1], bool)) == pytest.approx(-1)
    rng = np.random.default_rng(3)
    x = rng.random((20, 3)) @ rng.random((3, 15))
    w, h = M.nmf(x, 3, 2000)
    assert np.abs(w @ h - x).max() < 0.05 and (w >= 0).all() and (h >= 0).all()


def test_communities(spark):
    two = [(a, b, 1.0) for c in (0, 10) for a in range(c, c + 4) for b in range(a + 1, c + 4)] + [(3, 10, 0.1)]
    got = {r.node: r.community for r in M.communities(spark.createDataFrame(two, "a int, b int, weight double")).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(10, 14)}) == 1 and got[0] != got[10]


def test_prioritised_terms():
    t = pd.DataFrame({"term": ["root", "a", "b", "c"], "p": [0.02, 0.001, 0.01, 0.03], "z": [3.0, 4, 3, 3], "fdr": [0.05] * 4, "k": [5, 5, 5, 2]})
    assert M.prioritised_terms(t, {"a": {"root"}, "b": {"root"}}) == ["a", "b"]


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="the supplied tables are not here")
def test_reference_queries_take_whole_tables(spark):
    from exonloom.plans import registry

    d = "/root/testdata/sf0.001"
    rows = [(r.o_custkey, r.o_orderkey) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    got = registry.queries()["communities"](spark, d).collect()
    assert sorted(r.node for r in got) == sorted({v for a, b in rows if a != b for v in (a, b)})
    own = {}
    for gene, k in sorted(rows):
        own.setdefault(gene, []).append(f"E{k % 9 + 1}.{k % 3 + 1}")
    got = registry.queries()["collapse_core"](spark, d).collect()
    assert {(r.gene, r.structure, r.reads) for r in got} == {(g, "|".join(t), len(t)) for g, t in own.items()}


def test_gsea_of_a_long_list(spark):
    n = (1 << 20) + 8
    scores = spark.range(n).selectExpr("id as gene", "double(id % 1000) as score")
    terms = spark.createDataFrame([("t", g) for g in range(500, n, 99991)], "term string, gene bigint")
    r = M.gsea(scores, terms, 2).collect()
    gene = np.arange(n)
    order = np.lexsort((gene, -(gene % 1000)))
    assert [x.term for x in r] == ["t"] and r[0].es == pytest.approx(M.running_sum((gene % 1000)[order].astype(float), np.isin(order, range(500, n, 99991))))
