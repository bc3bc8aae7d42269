"""Credits against enumerated coalitions; names of sites against a walk over the regions."""

import itertools
import math
import random

import pytest

from exonloom.operators.annotation import site_names
from exonloom.operators.ranking import with_q
from exonloom.operators.scoring import credits


def enumerated(rows, mode, bonus):
    """rows: player -> metric values.  The pay of every coalition of others, weighed by its orders."""
    names, n = sorted(rows), len(rows)
    metrics = len(next(iter(rows.values())))
    out = {}
    for player in names:
        total = 0.0
        for j in range(metrics):
            v = rows[player][j]
            if mode.startswith("rank"):
                of = lambda x: sum(rows[q][j] <= rows[x][j] for q in names)
                best = max(rows[q][j] for q in names)
                place = {q: n if q == names[-1] and rows[q][j] + bonus >= best else of(q) for q in names}
                total += place[player] if mode == "rank" else (n if place[names[-1]] == n else 0)
                continue
            others = [q for q in names if q != player]
            for size in range(1, n):
                for team in itertools.combinations(others, size):
                    best = max(rows[q][j] for q in team)
                    place = size + 1 if v + bonus >= best else 1 + sum(rows[q][j] <= v for q in team)
                    pay = place if mode == "shapley" or place == size + 1 else 0
                    total += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * pay
        out[player] = total
    return out


@pytest.mark.parametrize("mode", ["shapley", "shapley_all_or_none", "rank", "rank_all_or_none"])
def test_credits_equal_enumeration(spark, mode):
    rng = random.Random(4)
    rows, want = [], {}
    for cell in range(25):
        kind = cell % 5  # plain, tied, near-tied, coarse, zero
        table = {f"p{k}": [(rng.random(), rng.choice([0.25, 0.5]), 0.5 + rng.choice([0, 0.0078125, 0.25]), rng.randrange(3) / 2, 0.0)[kind] for _ in range(3)] for k in range(rng.randrange(1, 6))}
        rows += [(cell, p, *v) for p, v in table.items()]
        want |= {(cell, p): x for p, x in enumerated(table, mode, 0.0078125).items()}
    df = spark.createDataFrame(rows, "cell bigint, player string, a double, b double, c double")
    got = {(r.cell, r.player): r.value for r in credits(df, "player", "cell", ["a", "b", "c"], mode, 0.0078125).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_global_q_equals_the_formula(spark):
    rng = random.Random(2)
    ps = [rng.choice([rng.random(), 0.01, 0.5, None]) for _ in range(300)]
    got = {r.k: r.q for r in with_q(spark.createDataFrame(list(enumerate(ps)), "k bigint, p double"), [], "p", ["k"]).collect()}
    known = sorted(p for p in ps if p is not None)
    for k, p in enumerate(ps):
        want = None if p is None else min([1.0] + [x * len(known) / (i + 1) for i, x in enumerate(known) if x >= p])
        assert got[k] == want or abs(got[k] - want) < 1e-12


def test_site_names_by_hand(spark):
    regions = [("g", 100, 199, "E1.1", "+"), ("g", 200, 499, "I1.1", "+"), ("g", 500, 600, "E2.1", "+")]
    regions += [("h", 500, 600, "E1.1", "-"), ("h", 200, 499, "I1.1", "-"), ("h", 100, 199, "E2.1", "-")]
    asked = {("g", 50): "U1.1", ("g", 150): "E1.1", ("g", 230): "E1.1", ("g", 300): "I1.1", ("g", 480): "E2.1", ("g", 700): "U3.1"}
    asked |= {("h", 700): "U1.1", ("h", 480): "E1.1", ("h", 300): "I1.1", ("h", 210): "E2.1", ("h", 50): "U3.1"}
    got = site_names(spark.createDataFrame(list(asked), "gene string, pos bigint"), spark.createDataFrame(regions, "gene string, start bigint, end bigint, region string, strand string"))
    assert {(r.gene, r.pos): r.name for r in got.collect()} == {k: f"{v}_{k[1]}" for k, v in asked.items()}


def test_sites_in_very_long_regions(spark):
    far = 10**13  # a region across ten billion bins of a fixed width
    regions = [("g", 0, far, "E1.1", "+"), ("g", far + 1, 2 * far, "E2.1", "+")]
    got = site_names(spark.createDataFrame([("g", 5), ("g", far + 5)], "gene string, pos bigint"), spark.createDataFrame(regions, "gene string, start bigint, end bigint, region string, strand string"))
    assert sorted(r.name for r in got.collect()) == sorted(["E1.1_5", f"E2.1_{far + 5}"])
