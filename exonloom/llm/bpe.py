"""Byte-level BPE as a streaming transducer with a bounded lookahead, and its inverse.

Encoding.  A merge (u, v) at some place can only be stopped from the right by an earlier merge (v, w), which itself
may be stopped.  Going through the merge list in order, ``reach[r]`` is how many bytes past uv can matter to merge r:
the largest, over earlier merges (v, w), of |w| plus what w and that merge need in turn.  Over all merges that could
still follow a token, this bounds the bytes after it that can change it: the list's sufficient lookahead.  So the
encoder holds a window of the piece, merges it, and emits the tokens that end further than the lookahead before the
window's end; what comes later can't change them, and the tokens after a boundary are the encoding of the bytes
after it.

A text is read in chunks that end where a piece must end, and each chunk's ids go into the hash, the count and the
decoder before the next chunk is read.  A piece without such an end in reach is fed to the transducer in parts.  So
beyond the text itself memory is that of a chunk and a window, however long the text or a piece of it is.

Decoding goes id by id: each adds bytes to a UTF-8 state machine that gives text out as soon as it is complete.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary's format).
PIECES = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over texts whose characters all lie below U+0100: letters, numbers and white space are written out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PIECES = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pieces whose ids are remembered; beyond that all are forgotten.
REMEMBERED = 500_000
#: Pieces of up to so many bytes are remembered; the transducer encodes all pieces, short or long.
SHORT = 64
#: Characters of a chunk, about, and pieces that are taken at a time where no chunk ends.
CHUNK, SOME = 1 << 16, 1 << 10
#: A space after a letter or digit begins a piece, whatever stands around it.
_BOUNDARY = re.compile(r"(?<=[0-9A-Za-z]) ")


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: themselves if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        as_bytes = lambda t: bytes(symbol[c] for c in t)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = [(as_bytes(u), as_bytes(v)) for u, v in pairs]
        #: left id * 2**20 + right id -> rank, and the whole's id by rank
        self.rank = {self.ids[u] << 20 | self.ids[v]: r for r, (u, v) in enumerate(self.merges)}
        self.whole = [self.ids[u + v] for u, v in self.merges]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The number of bytes after a token that can still change it, for any token and text."""
    follow: dict[bytes, int] = {}  # token -> most bytes after it that matter, as far as merges so far go
    whole: dict[bytes, int] = {}  # token -> most bytes after it that its being built needs
    for u, v in merges:
        needs = follow.get(v, 0)
        if u + v not in whole:
            whole[u + v] = max(needs, whole.get(v, 0), whole.get(u, 0) - len(v))
        else:
            whole[u + v] = max(whole[u + v], needs, whole.get(v, 0), whole.get(u, 0) - len(v))
        follow[u] = max(follow.get(u, 0), len(v) + max(whole.get(v, 0), needs))
    return max([0, *follow.values(), *whole.values()])


class Encoder:
    """Text to ids, piece by piece."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.v = vocabulary
        self.window = max(window or 0, 2 * vocabulary.lookahead + 64)
        self.pieces, self.latin_pieces = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.known: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a window: of all neighbours the pair of the lowest rank is merged, leftmost first, until none has one."""
        rank, whole, none = self.v.rank, self.v.whole, len(self.v.whole)
        byte_ids = self.v.byte_ids
        ids = [byte_ids[b] for b in data]
        if len(ids) < 2:
            return ids
        get = rank.get
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = new = whole[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], none)
            elif not ranks:
                break
        return ids

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of a piece that comes in parts; holds a window of bytes."""
        held, ahead, size = b"", self.v.lookahead, self.v.bytes_of
        for part in data:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                while len(held) >= self.window:
                    stable, end = 0, len(held) - ahead
                    for i in self.merged(held):
                        if stable + len(size[i]) > end:
                            break
                        stable += len(size[i])
                        yield i
                    held = held[stable:]
                    if not stable:
                        break
        yield from self.merged(held)

    def piece(self, text: str) -> bytes:
        """A piece's ids as little-endian 32-bit words."""
        data = text.encode("utf-8")
        out = packed(self.stream((data,)))
        if len(data) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = out
        return out

    def parts(self, text: str) -> Iterator[bytes]:
        """The whole text's ids as little-endian 32-bit words, chunk by chunk; special tokens' own strings are those tokens."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text, at, m.start())
            yield packed((self.v.special[m[0]],))
            at = m.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> bytes:
        """All of parts() in one."""
        return b"".join(self.parts(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of text[at:end], which holds no special token; ``at`` is always where a piece begins."""
        known = self.known
        while at < end:
            cut = end
            if end - at > 2 * CHUNK:
                m = _BOUNDARY.search(text, at + CHUNK, at + 2 * CHUNK)
                cut = m.start() if m else 0
            if cut:
                found = self._pattern(text[at:cut]).findall(text, at, cut)
                at = cut
                try:
                    yield b"".join(map(known.__getitem__, found))
                except KeyError:
                    yield b"".join([known.get(p) or self.piece(p) for p in found])
                continue
            for m in islice(self.pieces.finditer(text, at, end), SOME):
                lo, at = m.span()
                if at - lo <= SHORT:
                    yield known.get(m[0]) or self.piece(m[0])
                else:
                    ids = self.stream(text[k : min(k + CHUNK, at)].encode("utf-8") for k in range(lo, at, CHUNK))
                    while some := packed(islice(ids, SOME)):
                        yield some

    def _pattern(self, chunk: str) -> re.Pattern:
        try:
            chunk.encode("latin-1")
            return self.latin_pieces
        except UnicodeEncodeError:
            return self.pieces


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4 or array("H", [1]).tobytes() != b"\1\0":
        out = array("I", out)
        out.byteswap()
    return out.tobytes()


class Decoder:
    """Ids to text: a UTF-8 state machine that is fed token by token; bytes that are no text become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of, default=-1) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        """Text that is complete by now."""
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)

    def decode(self, parts: Iterable[bytes], step: int = 1 << 16) -> Iterator[str]:
        """The text of packed ids that come in parts, ``step`` tokens at a time."""
        self.state.reset()
        for ids in parts:
            view = memoryview(ids).cast("I")
            for at in range(0, len(view), step):
                yield self.feed(view[at : at + step])
        yield self.feed((), True)


def digest(encoder: Encoder, decoder: Decoder, text: str, kept: list[bytes] | None = None) -> tuple[int, str, str]:
    """(number of tokens, hash of the ids, hash of the text that they decode to); ids are added to ``kept`` if it is there."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def passed() -> Iterator[bytes]:
        nonlocal n
        for ids in encoder.parts(text):
            of_ids.update(ids)
            n += len(ids) // 4
            if kept is not None:
                kept.append(ids)
            yield ids

    for part in decoder.decode(passed()):
        of_text.update(part.encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(file: str) -> tuple[Encoder, Decoder]:
    """The file's encoder and decoder, read once in a worker."""
    if file not in _LOADED:
        v = Vocabulary(file)
        _LOADED[file] = (Encoder(v), Decoder(v))
    return _LOADED[file]


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, carry: Sequence[Column] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids: binary][, carry...]) for every row of ``docs``; no shuffle.

    Whole texts are encoded and the ids decoded again.  A null or empty text has no tokens and the hashes of nothing.
    Ids of rows may be null or repeat; each row is on its own.  ``file`` must be readable on the executors.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carry)
    own = [f.name for f in base.schema.fields[2:]]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in base.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got, tokens = [], []
                for text in some.column(1):
                    kept = [] if with_ids else None
                    got.append(digest(encoder, decoder, text.as_py() or "", kept))
                    tokens.append(b"".join(kept or ()))
                n, of_ids, of_text = zip(*got)
                cols = [some.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                cols += [pa.array(tokens, pa.binary())] * with_ids + some.columns[2:]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids, *own])

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
