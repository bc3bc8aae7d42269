"""Near-dedup against all pairs."""

import pathlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from exonloom.llm import common, minhash_dedup
from exonloom.llm.minhash_dedup import least_agreement, near_duplicates


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(k)] = min(low.get(top(k), doc), doc)
    out = []
    for k, (doc, _) in enumerate(rows):
        home = low.get(top(k)) if sets[k] else doc
        out.append((doc, len(sets[k]), home, doc == home))
    return out


@pytest.mark.parametrize("width,percent,m", [(3, 85, 6), (5, 80, 7)])
def test_equals_all_pairs(docs, width, percent, m):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in near_duplicates(docs, width=width, percent=percent, m=m).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, width, percent), key=str)
    assert any(r[0] != r[2] for r in got)


@pytest.mark.parametrize("pipeline", [False, True])
def test_no_join_gathers_a_table_on_the_driver(spark, docs, monkeypatch, pipeline):
    """Whatever the session's threshold, no step of op1 or of the pipeline's near-dedup plans a broadcast."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common_cut(df)

    common_cut = common.cut
    for module in (common, minhash_dedup, corpus_pipeline):
        monkeypatch.setattr(module, "cut", seen)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    seen(corpus_pipeline.one_of_near_copies(spark, docs, "") if pipeline else near_duplicates(docs, width=3, percent=85))
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_empty_table(docs):
    assert near_duplicates(docs.limit(0), width=3, percent=85).count() == 0


def test_bound_of_agreement():
    assert least_agreement(24, 85) <= 14 and least_agreement(28, 80) <= 15
    assert least_agreement(24, 30) <= 1  # for low similarities nothing is passed over
    assert least_agreement(10, 100) == 10


SF = pathlib.Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("width,percent,m", [(3, 85, 6), (5, 80, 7)])
def test_recall_on_the_supplied_documents(spark, width, percent, m):
    """The query's and the pipeline's parameters find every component of all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    holders, sets = {}, [shingles(t, width) for _, t in rows]
    pairs = set()
    for k, s in enumerate(sets):  # only sets that share a shingle can be similar
        near = set()
        for x in s:
            near.update(holders.setdefault(x, []))
            holders[x].append(k)
        pairs |= {(j, k) for j in near if 100 * len(sets[j] & s) >= percent * len(sets[j] | s)}
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in pairs:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), doc), doc)
    want = {doc: low[top(k)] for k, (doc, _) in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, width=width, percent=percent, m=m).collect()}
    assert len(pairs) > 20 and got == want


def test_bytes_rule_out_pairs_before_arrays_are_compared(spark):
    c = F.col
    rows = [([k * 7 - 5 for k in range(24)], [k * 7 - 5 + 3 * (k in odd) for k in range(24)], 24 - len(odd)) for odd in ((), (0, 7, 8, 23), range(24))]
    df = spark.createDataFrame(rows, "x array<int>, y array<int>, n int")
    pairs = zip(minhash_dedup._low_bytes(c("x"), 24), minhash_dedup._low_bytes(c("y"), 24))
    assert all(r.n == r.found for r in df.withColumn("found", sum(minhash_dedup._may_agree(*p) for p in pairs)).collect())
    nodes = spark.createDataFrame([(k, 20, [k] * 24) for k in range(15)], "node bigint, n bigint, mh array<int>")
    undecided = nodes.selectExpr("bigint(1) as key", "0 as table", "node", "n", "node as component", "bigint(0) as main")
    sets = nodes.select("node", F.lit(bytes(range(160))).alias("elements"))
    plan = minhash_dedup._late_pairs(undecided, nodes, sets, 85, 6, 2)._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.split("\n") if "Join" in line and "zip_with" in line]
    assert 0 < join.find("bit_count") < join.find("zip_with")
