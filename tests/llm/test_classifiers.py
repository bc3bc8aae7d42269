"""Quality and toxicity: held-out accuracy on the supplied tables, odd rows, missing labels."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from exonloom.llm import quality, toxicity
from exonloom.llm.shingles import minhashes, shingle_sets

DATA = pathlib.Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@needs_data
def test_quality_held_out(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = quality.training_rows(4, 2)
    model = quality.fitted(docs, labels, where=rows)
    got = quality.scored(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(~rows(F.col("doc_id"))).collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.97
    kept = quality.scored(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == quality.scored(docs, model).filter("predicted = 1").count()


@needs_data
def test_toxicity_marks_insults(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fitted(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 3
    got = toxicity.severity(docs, model).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r for r in got if r.y == 0]
    bad = [r for r in got if r.y == 1 and r.lang == "en"]
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad)
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade >= 1) for r in got)


def test_odd_rows_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        q = quality.scored(docs, quality.fitted(docs, labels)).collect()
        assert len(q) == docs.count() and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in q)
        t = toxicity.severity(docs, toxicity.fitted(docs, labels)).collect()
        assert len(t) == docs.count() and not any(r.toxic for r in t)
    assert toxicity.severity(docs, toxicity.fitted(docs, none), keep=True).columns == docs.columns
    assert quality.scored(docs.limit(0), quality.Discriminant()).count() == 0


def test_log_density_is_the_gaussians(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, (300, 15)), rng.normal(1.5, 2, (300, 15))))
    y = np.repeat([0, 1], 300)
    m = quality.fit(x, y)
    z = (x - m.centre) / m.scale
    for k in (0, 1):
        cov = np.linalg.inv(m.whiten[k].T @ m.whiten[k])
        direct = np.einsum("ij,jk,ik->i", z - m.means[k], np.linalg.inv(cov), z - m.means[k])
        assert np.allclose(direct, (((z - m.means[k]) @ m.whiten[k].T) ** 2).sum(1))
        assert np.isclose(np.linalg.slogdet(cov)[1], m.log_det[k])
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95


def test_a_shared_passage_is_no_near_copy():
    rng = np.random.default_rng(4)
    footer = " ".join(f"footer{k}" for k in range(40))
    own = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 120)) for _ in range(60)]
    texts = [f"{t} {footer}" for t in own] + [f"{t} {footer} edited" for t in own[:10]]
    marks = [minhashes([s], toxicity.MARKS).tobytes() for s in shingle_sets(texts)]
    assert toxicity.one_of_each([(1, m) for m in marks]) == list(range(60))
    assert toxicity.one_of_each([(1, b""), (1, b""), (0, marks[0]), (1, marks[0])]) == [0, 1, 2, 3]
