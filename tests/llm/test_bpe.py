"""The transducer against the tokenizers library, and the round trip."""

import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from exonloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def samples():
    rng = random.Random(9)
    out = ["", "a", " ", "  x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "it's we'll I'M", "\x85\x1c x", "﻿x", "a" * 5000, "=" * 3000, " " * 3000, "漢字" * 700, "x́y²½"]
    for alphabet in ("abcdefgh ", "aeiou", " \n\t", "0123456789", "=-_*# ", "é☃漢\U0001f600 a", "theing "):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (7, 90, 700, 4000)]
    return out


def test_same_ids_and_text_as_the_library(library):
    encoder, decoder = bpe.loaded(FILE)
    for text in samples():
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:40]
        assert "".join(decoder.decode([encoder.encode(text)], step=3)) == text


def test_streamed_piece_in_any_parts(library):
    encoder = bpe.loaded(FILE)[0]
    text = "thethereandinginging" * 400
    want = library.encode(text, add_special_tokens=False).ids
    for step in (1, 17, 1000):
        data = text.encode()
        assert list(encoder.stream(data[k : k + step] for k in range(0, len(data), step))) == want


def test_decoder_replaces_what_is_no_text(library):
    decoder = bpe.Decoder(bpe.Vocabulary(FILE))
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert "".join(decoder.decode([bpe.packed(ids)], step=2)) == library.decode(ids, skip_special_tokens=False)


def test_query_rows(docs, library):
    got = bpe.encoded(docs, FILE).collect()
    assert len(got) == docs.count()
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    for (_, _, text), r in zip(texts, sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encoded(docs.limit(0), FILE).count() == 0


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) >= 2


def toy(merges):
    """A vocabulary of single bytes and what the merges make."""
    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    v.ids = {bytes([b]): b for b in range(256)}
    for u, w in merges:
        v.ids.setdefault(u + w, len(v.ids))
    v.special, v.bytes_of, v.merges = {}, {i: t for t, i in v.ids.items()}, merges
    v.rank = {v.ids[u] << 20 | v.ids[w]: r for r, (u, w) in reversed(list(enumerate(merges)))}
    v.whole = [v.ids[u + w] for u, w in merges]
    v.byte_ids = list(range(256))
    v.lookahead = bpe.sufficient_lookahead(merges)
    return v


def test_lookahead_is_sufficient_for_random_lists():
    """Whatever follows, tokens that end further than the lookahead before the end of what is known stay as they are."""
    rng = random.Random(8)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"][: rng.choice((2, 3))], []
        for _ in range(rng.randrange(1, 7)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if len(pair[0] + pair[1]) <= 6 and pair not in merges and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        encoder = bpe.Encoder(toy(merges))
        size, ahead = encoder.v.bytes_of, encoder.v.lookahead
        letters = [t[0] for t in tokens if len(t) == 1]
        for _ in range(15):
            known = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 16)))
            own, end = [], 0
            for i in encoder.merged(known):
                end += len(size[i])
                if end > len(known) - ahead:
                    break
                own.append(i)
            for n in (1, 2, 3):
                for more in itertools.product(letters, repeat=n):
                    assert encoder.merged(known + bytes(more))[: len(own)] == own, (merges, known, more)


def test_chunks_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "SOME", 3)
    encoder, decoder = bpe.loaded(FILE)
    for text in [*samples(), "word " * 500, "漢字 " * 300 + "x" * 500 + " é" * 90]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(decoder.decode(encoder.parts(text))) == text


@pytest.mark.parametrize("unit", ["The quick brown fox, 42 times. ", "x", "漢字"])
def test_memory_does_not_grow_with_the_text(unit):
    encoder, decoder = bpe.loaded(FILE)
    peaks = []
    for size in (200_000, 400_000) if unit == "x" else (300_000, 900_000):
        text = unit * (size // len(unit))
        bpe.digest(encoder, decoder, text[:200_000])  # its pieces are known
        tracemalloc.start()
        bpe.digest(encoder, decoder, text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.1 * peaks[0] + 100_000, peaks
