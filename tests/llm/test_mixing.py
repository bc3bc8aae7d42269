"""Mixing against a plain running total per source."""

import hashlib
import math
import re

from exonloom.llm import mixing


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for r, n in zip(rows, size) if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s], left = 2 * total[s], left - 2 * total[s]
        open_ -= full
    out = []
    for s in sources:
        own = [(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, n, r.doc_id) for r, n in zip(rows, size) if r.source == s]
        at = 0
        for _, _, _, n, doc in sorted(own):
            most = math.floor(target[s])
            taken = sum(max(0, min(n, most - at - p * total[s])) for p in (0, 1))
            out.append((doc, n, total[s], round(target[s], 6), taken))
            at += n
    return out


def test_equals_running_totals(docs):
    got = mixing.mix_sources(docs).collect()
    want = brute(docs.collect())
    assert sorted([(r.doc, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got], key=str) == sorted(want, key=str)
    assert all(r.taken <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r.target, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in per.values())
    assert all(0 <= p < mixing.SCALE and list(r.positions) == sorted(r.positions) for r in got for p in r.positions)


def test_training_order_repeats_rows_as_taken(docs):
    got = mixing.training_order(mixing.mix_sources(docs, carry=True))
    assert got.columns == docs.columns
    passes = sum(len(r.positions) for r in mixing.mix_sources(docs).collect())
    assert got.count() == passes > docs.count() / 2


def test_empty_and_wordless(spark, docs):
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix_sources(none).collect()] == [(0, 0.0, 0)] * 2
