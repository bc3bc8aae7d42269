"""Nearest neighbours and near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from exonloom.llm import cross_polytope, itq

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, v int"


def cosines(x):
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype("f4")
    for k in range(60):  # near copies at all distances, then exact ones
        x[200 + k] = x[k % 6] + rng.normal(size=16).astype("f4") * (k / 90)
    x[300:330] = x[7]
    rows = [(k, [float(v) for v in x[k]], int(k % 2) if k < 200 else int(k % 6 % 2), "n", 1) for k in range(400)]
    rows = [(r[0], r[1], 1 if 300 <= r[0] < 330 or r[0] == 7 else r[2], *r[3:]) for r in rows]
    odd = [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] + [1.0] * 15, 1), (1150, [None] + [1.0] * 15, 1), (1200, [1.0, 2.0], 1), (1250, rows[7][1], None), (None, rows[8][1], 0)]
    return rows, spark.createDataFrame(rows + [(*o, "n", 1) for o in odd], SCHEMA)


def test_nearest(vectors):
    rows, df = vectors
    got = cross_polytope.nearest(df).collect()
    c = cosines([r[1] for r in rows] + [rows[7][1]])
    ids = [r[0] for r in rows] + [1250]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in ids if i % 50 == 0]
    hit = total = 0
    for q, own in by.items():
        k = ids.index(q)
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in own)
        assert all(abs(r.score - c[k, ids.index(r.vec_id)]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-round(c[k, j], 12), ids[j]))[:5]
        hit += len({ids[j] for j in best} & {r.vec_id for r in own})
        total += 5
    assert hit >= 0.9 * total
    same = [r.vec_id for r in sorted(by[300], key=lambda r: r["rank"])]
    assert same == [7, 301, 302, 303, 304]


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5]), (2, [-1.0, 0.5])], "vec_id bigint, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in cross_polytope.nearest(df, tables=1, probes=1).collect())
    assert got == [(1, 1), (2, 2)]
    assert cross_polytope.nearest(df.limit(0)).count() == 0


def test_near_duplicates(vectors):
    rows, df = vectors
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    c = cosines([r[1] for r in rows]) >= 0.93
    labels = np.array([r[2] for r in rows])
    c &= labels[:, None] == labels[None]
    np.fill_diagonal(c, False)
    home = np.arange(len(rows))
    while True:
        low = np.array([min(home[k], home[c[k]].min(initial=home[k])) for k in range(len(rows))])
        if (low == home).all():
            break
        home = low
    found = sum(got[k].n_links for k in range(len(rows)))
    assert found >= 0.98 * c.sum() and all(got[k].n_links <= c[k].sum() for k in range(len(rows)))
    if found == c.sum():
        assert [got[k].component_id for k in range(len(rows))] == home.tolist()
    for k in (1000, 1050, 1100, 1150, 1200, 1250, None):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = 1 + rng.normal(size=(60, 8)) * 0.02
    df = spark.createDataFrame([(k, x[k].tolist(), 0) for k in range(60)], "vec_id bigint, embedding array<double>, label int")
    assert [(r.n_links, r.component_id) for r in itq.near_duplicates(df).collect()] == [(59, 0)] * 60


def test_plan_of_tables_has_no_bound_on_bits():
    for n in (1, 10**3, 10**6, 10**9, 10**12):
        bits, tables = itq.plan(n, 0.93)
        assert n / 2**bits < 1000 and (1 - 0.8803**bits) ** tables <= 0.0051


def test_a_pair_at_the_threshold_is_linked_in_any_block(spark):
    rng = np.random.default_rng(3)
    at = np.array([0.93, np.sqrt(1 - 0.93**2), 0.0, 0.0])
    exact = float((np.array([1.0, 0.0, 0.0, 0.0]) * at).sum() / np.linalg.norm(at))
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 0), (1, at.tolist(), 0)] + [(k, rng.normal(size=4).tolist(), 0) for k in range(2, 40)]
    for n in (2, 7, 40):
        df = spark.createDataFrame(rows[:n], "vec_id bigint, embedding array<double>, label int")
        got = {r.vec_id: r for r in itq.near_duplicates(df, cosine=exact).collect()}
        assert got[0].n_links >= 1 and got[1].component_id == 0


def test_many_vectors_of_one_direction_tie_by_id(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    rows = [(k, (one * 2.0 ** (k % 60)).tolist()) for k in range(1, 61)] + [(100 + k, rng.normal(size=8).tolist()) for k in range(200)]
    got = cross_polytope.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).filter("query_id = 50")
    assert sorted((r["rank"], r.vec_id) for r in got.collect()) == [(k, k) for k in range(1, 6)]


def test_places_and_probes_agree():
    """A vector's own cell is the first that it probes; probed cells are the best of all by the sum of gaps."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (10, 3_000, 200_000):
        cells = cross_polytope.Cells(6, n, 2, 40)
        for t in range(2):
            own = cells.own(x, t)
            probed = cells.probed(x, t)
            assert all((probed[0][:, 0] == own[0]) & (probed[1][:, 0] == own[1]))
            gaps = [np.sort((y.max(1, keepdims=True) - y) ** 2, 1) for y in (cells._signed(x, t, k) for k in range(len(cells.axes)))]
            assert len(gaps) == len(cells.axes) and probed[0].shape == (20, min(40, np.prod([2 * m for m in cells.axes])))
            for r in range(20):
                assert len(set(zip(probed[0][r], probed[1][r]))) == probed[0].shape[1]
