"""The trie's probabilities against a plain PPM with symbol exclusion, and the base score against counting."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from exonloom.llm import ppm


def plain_log10(train, text, order):
    """PPM by the book: method D, exclusion, contexts as byte strings."""
    seen = defaultdict(Counter)
    pad = b"\n" * order
    for s in train:
        s = pad + s
        for i in range(order, len(s)):
            for j in range(order + 1):
                seen[s[i - j : i]][s[i]] += 1
    total, s = 0.0, pad + text
    for i in range(order, len(s)):
        out, done = set(), False
        for j in range(order, -1, -1):
            c = {k: n for k, n in seen.get(s[i - j : i], {}).items() if k not in out}
            if not c:
                continue
            n = sum(c.values())
            if s[i] in c:
                total += math.log10((c[s[i]] - 0.5) / n)
                done = True
                break
            total += math.log10(len(c) / 2 / n)
            out |= set(c)
        if not done:
            total -= math.log10(256 - len(out))
    return total


def test_equals_plain_ppm(spark, docs):
    short = docs.filter("length(text) < 400 or text is null")
    rows = short.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    train = [ppm.stream_of(r.text) for r in rows if not held(r)]
    got = ppm.score_texts(short, order=3).collect()
    want = sorted(round(plain_log10(train, ppm.stream_of(r.text), 3), 6) for r in rows)
    assert np.allclose(sorted(r.score for r in got), want, atol=1e-5)


def test_base_score_and_counts(docs):
    rows = docs.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    c, texts = Counter(), 0
    for r in rows:
        if not held(r):
            c.update((r.text or "").encode().lower().split())
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    want = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        want.append((held(r), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 4)))
    for most in (1 << 19, 20):
        got = ppm.score_texts(docs, most_words=most).collect()
        assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)


def test_pruned_trie_still_adds_up_and_empty(docs):
    trie = ppm.Trie([(np.array([97, 98], np.uint64), np.array([5, 3])), (np.array([97 << 8 | 98], np.uint64), np.array([3]))])
    for context in (97, 98, 120):
        p = 10 ** trie.log10(np.array([context << 8 | b for b in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    assert ppm.score_texts(docs.limit(0)).count() == 0
    assert ppm.score_texts(docs.filter("length(text) < 400"), most_nodes=50).count() > 0


def test_rare_grams_count_in_full(docs):
    """A small broadcast changes no score: grams that it hasn't room for are joined."""
    short = docs.filter("length(text) < 400 or text is null")
    whole = sorted(r.score for r in ppm.score_texts(short).collect())
    for most in (0, 50):
        assert np.allclose(sorted(r.score for r in ppm.score_texts(short, most_nodes=most).collect()), whole, atol=1e-7)


def test_order_five_equals_plain_ppm(spark, docs):
    short = docs.filter("length(text) < 400 or text is null")
    rows = short.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    train = [ppm.stream_of(r.text) for r in rows if not held(r)]
    want = sorted(plain_log10(train, ppm.stream_of(r.text), 5) for r in rows)
    assert np.allclose(sorted(r.score for r in ppm.score_texts(short, most_nodes=200).collect()), want, atol=1e-5)


def test_a_batch_of_many_texts_takes_little_memory(monkeypatch):
    """Texts become Python's strings slice by slice, and counts leave the task in small batches."""
    text = " ".join(f"word{k} {k * k}" for k in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k} {text}" for k in range(1500)] + [None, ""]), pa.array([False] * 1502)], names=["text", "held"])
    tracemalloc.start()
    out = list(ppm._counted(3)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 25_000_000 and most < 1.5 * batch.nbytes
    monkeypatch.setattr(ppm, "_ROWS", 500)
    small = list(ppm._counted(3)(iter([batch])))
    assert max(b.num_rows for b in small) <= 500 and pa.Table.from_batches(small).equals(pa.Table.from_batches(out))
