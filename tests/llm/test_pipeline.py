"""The pipeline's stages in turn, each against its operator's rule."""

import pathlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="the supplied tables are not here")
def test_stages(spark, tmp_path):
    from exonloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts, left = docs.columns, {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = [r.doc_id for r in docs.collect()]
        assert name == "bpe" or docs.columns == columns
    q = {r.doc_id for r in QUERIES["op6_quality"](spark, DATA).filter("predicted = 1").collect()}
    assert set(left["quality"]) == q
    assert set(left["toxicity"]) <= q and len(left["toxicity"]) >= 0.7 * len(q)

    def shingles(doc):
        w = texts[doc].lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    kept, before = left["near_dedup"], left["toxicity"]
    sets = {d: shingles(d) for d in before}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    home = {d: d for d in before}
    for a in sorted(before):
        for b in before:
            if a < b and near(a, b):
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = {d: new if h == old else h for d, h in home.items()}
    assert sorted(kept) == sorted(set(home.values()))
    assert set(left["mixing"]) <= set(kept) and max(left["mixing"].count(d) for d in kept) <= 2
    assert sorted(left["bpe"]) == sorted(left["mixing"])
    assert docs.columns[:2] == ["doc_id", "n_tokens"]
    # the training order of the mix is in the last table
    from exonloom.llm import mixing

    before = spark.read.parquet(str(tmp_path / "near_dedup"))
    due = mixing.mix_sources(before).selectExpr("doc", "explode(positions) AS p").orderBy("p", "doc").collect()
    assert [r.doc_id for r in docs.orderBy("position").collect()] == [r.doc for r in due]


def test_run_equals_the_stages_rules_on_odd_rows(spark, tmp_path):
    """run() on a table with nulls, repeats, empty texts and an extra column against the rules, one by one."""
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from exonloom.llm import mixing, quality, toxicity
    from exonloom.llm.queries import vocabulary_file

    good = lambda k, n=80: " ".join(f"word{k}s{i % 37}" + "." * (i % 9 == 8) for i in range(n))
    rows = [(k, good(k), "en", f"s{k % 3}" if k % 5 else None, 1, k) for k in range(40)]
    rows += [rows[3], rows[3], (None, good(50), None, None, None, 1), (None, good(50), None, None, None, 1), (77, "", "en", "s1", 0, 1), (78, None, "en", "s1", 0, 1), (None, None, None, None, None, None)]
    rows += [(100 + k, good(k) + " tail", "en", "s0", 1, 1) for k in range(5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    for name, n in (("some", None), ("none", 0)):
        (docs if n is None else docs.limit(n)).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).orderBy("position").collect()

    left = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    model = quality.fitted(left, labels, where=quality.training_rows(4, 2))
    keep = {t for t in {r.text for r in left.collect()} if model.score(np.array([quality.statistics(t)]))[0] >= 0.7}
    assert toxicity.fitted(left, labels).weights == {}
    one = {}
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in keep if t}
    for r in sorted((r for r in left.collect() if r.text in keep), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if not r.text:
            one[len(one)] = r
        elif not any(q.text and len(sets[q.text] & sets[r.text]) >= 0.8 * len(sets[q.text] | sets[r.text]) for q in one.values()):
            one[len(one)] = r
    mixed = mixing.mix_sources(spark.createDataFrame(list(one.values()), left.schema), carry=True)
    want = mixed.select("doc", "size", "row.text", F.explode("positions").alias("p")).orderBy("p", "doc", "size").collect()
    library = Tokenizer.from_file(vocabulary_file())
    ids = [library.encode(r.text, add_special_tokens=False).ids for r in want]
    assert len(want) > 20
    assert [(r.doc_id, r.n_tokens, r.ids_sha256) for r in got] == [(r.doc, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for r, i in zip(want, ids)]
    assert all(r.decoded_sha256 == hashlib.sha256(w.text.encode()).hexdigest() for r, w in zip(got, want))


def test_near_copies_of_null_and_repeated_ids(spark):
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1)), (None, words(1)), (None, words(2)), (None, words(2)), (None, words(2) + " more"), (3, words(3)), (3, words(4)), (3, words(3)), (None, words(5)), (9, words(5) + " more"), (4, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.one_of_near_copies(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or " ").split(" ")[0]) for r in out.collect()), key=str)
    assert got == sorted([(1, "w1x0"), (None, "w2x0"), (3, "w3x0"), (3, "w4x0"), (9, "w5x0"), (4, ""), (None, "")], key=str)
