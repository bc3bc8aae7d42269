"""Language-model scores by prediction by partial matching over bytes.

A text is coded as its lower-cased words, a space between them and a newline at the end.  The trie of byte contexts
up to ``order`` bytes is held level by level as sorted arrays.  A byte is predicted from the longest context seen;
if that has not led to it, the escape (method D: half a count from each distinct follower) is paid and the next
shorter context is asked, with the symbols that the longer one had excluded.  What a context has seen, every shorter
one has seen as well, so the excluded set is always the last context's followers, and its total in the next context
is one number per context.  The probabilities are those of the pretrained trie, so a byte's cost depends on the gram
of its context and itself alone: every distinct gram of the texts is costed once, by joins of count tables, and the
texts' bytes look their costs up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exonloom.llm.common import crc_remainder, cut, discard, trimmed
from exonloom.llm.shingles import slices, word_hashes

#: Context bytes at most; a gram, with the byte that follows, fits 64 bits.
ORDER = 5
#: Grams whose costs are broadcast at most, 16 bytes each; the others' are joined.
MOST_NODES = 1 << 22
#: Levels up to this context length are asked in memory: their size is bounded by the alphabet, not by the texts.
LOW = 2
#: Words whose counts are broadcast at most, 16 bytes each; the others' are joined.
MOST_WORDS = 1 << 19
#: Bytes of text that are counted at a time, and scored at a time: beside the costs, some 100 bytes of memory for each.
SLICE = 1_000_000
_SCORED = 250_000
#: Counts that a task holds of a kind, and rows that it hands on at a time.
_HELD = 1_500_000
_ROWS = 100_000


def stream_of(text: str | None) -> bytes:
    """The bytes that the model codes."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


def grams_of(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the gram of ``order`` bytes before it and itself, and where each stream's grams begin.
    Before a stream's first byte stand newlines."""
    pad = b"\n" * order
    raw = np.frombuffer(b"".join(pad + s for s in streams), np.uint8).astype(np.uint64)
    n = len(raw) - order
    g = np.zeros(max(n, 0), np.uint64)
    for k in range(order + 1):
        g = (g << np.uint64(8)) | raw[k : k + len(g)]
    sizes = np.array([len(s) for s in streams])
    begins = np.cumsum([0, *sizes[:-1]])
    own = np.ones(len(g), bool)
    # the grams that end in a stream's padding are none
    for k in range(1, len(streams)):
        at = begins[k] + k * order
        own[at - order : at] = False
    return g[own], begins


def _lengths(texts: pa.Array) -> list[int]:
    """Bytes of each text, without making Python's strings of all of a batch."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(order: int):
    """Texts to (kind, key, n): grams (0), words' hashes (1) and texts (2) of training texts, and grams of held-out
    ones (3), summed up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: [], 3: []}
        docs = 0

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = _merged(held[kind])
            held[kind] = []
            for k in range(0, len(keys), _ROWS):
                own = keys[k : k + _ROWS].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(counts[k : k + _ROWS])], names=["kind", "key", "n"])

        for batch in batches:
            apart = batch.column(1).to_pylist()
            docs += apart.count(False)
            for lo, hi in slices(_lengths(batch.column(0)), SLICE):
                texts = batch.column(0)[lo:hi].to_pylist()
                train = [stream_of(t) for t, h in zip(texts, apart[lo:hi]) if not h]
                other = [stream_of(t) for t, h in zip(texts, apart[lo:hi]) if h]
                for kind, keys in ((0, grams_of(train, order)[0]), (1, word_hashes(b"".join(train))[0]), (3, grams_of(other, order)[0])):
                    held[kind].append(tuple(x.astype(np.int64) if i else x for i, x in enumerate(np.unique(keys, return_counts=True))))
                    if sum(len(p[0]) for p in held[kind]) > _HELD:
                        held[kind] = [_merged(held[kind])]
                        if len(held[kind][0][0]) > _HELD // 2:
                            yield from out(kind)
        for kind in held:
            if held[kind]:
                yield from out(kind)
        trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])

    return run


@dataclass
class Level:
    """Contexts of one length: sorted grams with counts; sorted contexts with totals, numbers of followers, and what
    their followers count in the next shorter context."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    below: np.ndarray


class Coding:
    """The costs of grams while contexts are asked, from the longest to the shortest."""

    def __init__(self, size: int):
        self.out = np.zeros(size)
        self.todo = np.arange(size)  # grams whose byte isn't coded yet
        self.excluded = np.zeros(size)  # followers of the last context asked, and what they count in the next
        self.taken = np.zeros(size)

    def ask(self, known: np.ndarray, hit: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> None:
        """One context for each gram in ``todo``: whether it is known and has led to the byte, and its numbers."""
        todo = self.todo
        fresh, denominator = kinds - self.excluded[todo], total - self.taken[todo]
        pay = known & (fresh > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.log10(np.where(hit, count - 0.5, fresh / 2) / denominator)
        self.out[todo[pay]] += cost[pay]
        self.excluded[todo[known]] = kinds[known]
        self.taken[todo[known]] = below[known]
        self.todo = todo[~hit]

    def end(self) -> np.ndarray:
        self.out[self.todo] -= np.log10(256 - self.excluded[self.todo])
        return self.out


class Trie:
    """The levels of contexts, from the empty one to the longest."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for j, (grams, counts) in enumerate(levels):
            by = np.argsort(grams)
            grams, counts = grams[by].astype(np.uint64), counts[by].astype(np.float64)
            context = grams >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(grams) else np.zeros(0, int)
            total = np.add.reduceat(counts, first) if len(first) else counts
            below = total * 0
            if j and len(first):
                short = self.levels[-1]
                at = np.searchsorted(short.grams, grams & np.uint64((1 << 8 * j) - 1))
                below = np.add.reduceat(short.counts[at], first)
            self.levels.append(Level(grams, counts, context[first], total, np.diff(np.append(first, len(grams))).astype(float), below))

    def log10(self, grams: np.ndarray, coding: Coding | None = None) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it; ``coding`` has what longer
        contexts than the trie's have cost."""
        coding = coding or Coding(len(grams))
        for j in range(len(self.levels) - 1, -1, -1):
            level, todo = self.levels[j], coding.todo
            if not len(level.grams) or not len(todo):
                continue
            q = grams[todo] & np.uint64((1 << 8 * (j + 1)) - 1)
            c = np.minimum(np.searchsorted(level.contexts, q >> np.uint64(8)), len(level.contexts) - 1)
            known = level.contexts[c] == q >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.grams, q), len(level.grams) - 1)
            coding.ask(known, known & (level.grams[at] == q), level.counts[at], level.total[c], level.kinds[c], level.below[c])
        return coding.end()


def _costs(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(key, m, cost) for every row of ``grams`` (key, n in training texts, m in all), and the table of shorter grams
    that it is computed from.

    A gram that training has seen is coded by its longest context.  The others ask one level after the other: what
    contexts longer than LOW know is joined, the rest is in memory.
    """
    low = min(order, LOW)
    mask = lambda c, j: c if j >= order else c.bitwiseAND((1 << 8 * (j + 1)) - 1)
    context = lambda c: F.shiftrightunsigned(c, 8)
    seen = grams.filter("n > 0")
    levels = {order: seen.select("key", "n")}
    for j in range(order - 1, -1, -1):
        levels[j] = levels[j + 1].groupBy(mask(F.col("key"), j).alias("key")).agg(F.sum("n").alias("n"))
    nodes = [levels[j].select(F.lit(j).alias("level"), "key", "n") for j in range(order - 1, -1, -1)]
    for more in nodes[1:]:
        nodes[0] = nodes[0].unionByName(more)
    nodes = cut(nodes[0])
    levels |= {j: nodes.filter(F.col("level") == j).select("key", "n") for j in range(order)}
    known = grams.sparkSession.sparkContext.broadcast(Trie([_arrays(levels[j]) for j in range(low + 1)]))

    first = seen.withColumn("total", F.sum("n").over(Window.partitionBy(context(F.col("key")))))
    first = first.select("key", "m", F.log10((F.col("n") - 0.5) / F.col("total")).alias("cost"))
    other = grams.filter("n = 0").select("key", "m")
    asked = list(range(order, low, -1))
    for j in asked:
        own = mask(F.col("key"), j)
        shorter = levels[j].withColumn("below", F.sum("n").over(Window.partitionBy(mask(F.col("key"), j - 1))))
        contexts = shorter.groupBy(context(F.col("key")).alias(f"c{j}")).agg(F.sum("n").alias(f"total{j}"), F.count("*").alias(f"kinds{j}"), F.sum("below").alias(f"below{j}"))
        other = other.join(contexts, context(own) == F.col(f"c{j}"), "left")
        if j < order:
            other = other.join(levels[j].select(F.col("key").alias(f"g{j}"), F.col("n").alias(f"n{j}")), own == F.col(f"g{j}"), "left")
        else:
            other = other.withColumn(f"n{j}", F.lit(0))
    numbers = [f"{name}{j}" for j in asked for name in ("n", "total", "kinds", "below")]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, coding = batch.column(0).to_numpy().view(np.uint64), Coding(batch.num_rows)
            for k, _ in enumerate(asked):
                n, total, kinds, below = (batch.column(2 + 4 * k + i).to_numpy()[coding.todo].astype(float) for i in range(4))
                coding.ask(kinds > 0, n > 0, n, total, kinds, below)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.value.log10(keys, coding))], names=["key", "m", "cost"])

    other = other.select("key", "m", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers))
    return first.unionByName(other.mapInArrow(coded, "key bigint, m bigint, cost double")), nodes


def _bound(counts: DataFrame, most: int) -> int:
    """The least count such that no more than ``most`` rows have it or more, from the counts of counts."""
    exact = 1 << 12  # counts above that are taken by powers of two
    step = F.when(F.col("n") < exact, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("bigint"))
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"])
    total, least = 0, (rows[0]["step"] + 1 if rows else 1)
    for r in rows:
        total += r["rows"]
        if total > most:
            break
        least = r["step"]
    return least if total > most else 1


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = 7, without: int = 2, order: int = ORDER, most_nodes: int = MOST_NODES, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Texts whose crc32(id as text) modulo ``of`` is ``without`` are held out; grams and words of all others are
    counted, in whole, by sums within tasks and then over all.  ``score`` is the log10 probability that the trie
    gives the text; it holds every counted gram.  The costs of the ``most_nodes`` grams that the texts have most often
    are broadcast, those of all others are joined, and being rare they gather nowhere.  ``base_score`` is add-one over whole words, the
    end of a text being one; it needs every word's exact count: those of frequent words are broadcast, within
    ``most_words``, those of all others are joined, and being rare they gather nowhere.

    Defined results: a null or empty text is its end alone.  A row with a null id is not held out.  Repeated rows
    count and come out as often as they are there.  Without training rows every byte costs 1/256 and every word 1.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(crc_remainder(F.col(f"`{id_col}`"), of) == without, F.lit(False)).alias("held"))
    train = F.col("kind") != 3
    counted = base.select("text", "held").mapInArrow(_counted(order), "kind int, key bigint, n bigint")
    counted = counted.groupBy(F.when(train, F.col("kind")).otherwise(0).alias("kind"), "key").agg(F.sum(F.when(train, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m"))
    counted = cut(counted)
    texts, words, distinct = counted.agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.count_if(F.col("kind") == 1)).first()
    texts, words = texts or 0, words or 0
    n, v = words + texts, distinct + (texts > 0)

    costs, nodes = _costs(counted.filter("kind = 0").select("key", "n", "m"), order)
    costs = cut(costs)
    discard(nodes)
    common = _bound(costs.select(F.col("m").alias("n")), most_nodes)
    grams, prices = _arrays(costs.filter(F.col("m") >= common).select("key", "cost"))
    order_of = np.argsort(grams)
    grams, prices = grams[order_of], prices[order_of]
    whole = common <= 1
    counts = counted.filter("kind = 1").select("key", "n")
    often = _bound(counts, most_words)
    frequent, times = _arrays(counts.filter(F.col("n") >= often))
    by = np.argsort(frequent)
    everything = often <= 1
    known = docs.sparkSession.sparkContext.broadcast((grams, prices, frequent[by], times[by]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priced, prices, frequent, times = known.value
        task, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(_lengths(batch.column(1)), _SCORED):
                streams = [stream_of(t) for t in batch.column(1)[lo:hi].to_pylist()]
                grams, begins = grams_of(streams, order)
                seen, at = np.unique(grams, return_inverse=True)
                place = np.minimum(np.searchsorted(priced, seen), max(len(priced) - 1, 0))
                found = priced[place] == seen if len(priced) else np.zeros(len(seen), bool)
                score = np.add.reduceat((np.where(found, prices[place], 0) if len(priced) else np.zeros(len(seen)))[at], begins)
                other = np.flatnonzero(~found[at])
                others = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(other, begins), len(other)).astype(np.int32)), pa.array(grams[other].view(np.int64)))
                hashes, starts = word_hashes(b"".join(streams))
                first = np.searchsorted(starts, begins)
                per = np.diff(np.append(first, len(hashes)))
                row = np.repeat(np.arange(hi - lo), per)
                kinds, at = np.unique(hashes, return_inverse=True)
                c = np.zeros(len(kinds), np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
                    c = np.where(frequent[place] == kinds, times[place], 0)
                own = c[at]
                logs = np.bincount(row, np.log10(own + 1.0), hi - lo) + np.log10(len_texts + 1.0)
                hits = np.bincount(row, own > 0, hi - lo).astype(np.int64) + (len_texts > 0)
                rare = (own == 0) & (not everything)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[rare], minlength=hi - lo)))).astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[rare].view(np.int64)))
                uid = pa.array((task << 33) + rows + np.arange(hi - lo))
                rows += hi - lo
                yield pa.RecordBatch.from_arrays([uid, batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(per + 1), pa.array(hits), pa.array(logs), pa.array(score), left, others], names=["uid", "id", "held", "n_tokens", "hits", "logs", "score", "rare", "grams"])
            trimmed()

    len_texts = texts
    out = cut(base.select("id", "text", "held").mapInArrow(scored, f"uid bigint, id {kind}, held boolean, n_tokens bigint, hits bigint, logs double, score double, rare array<bigint>, grams array<bigint>"))
    if not everything:
        left = out.select("uid", F.explode("rare").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("times"))
        left = left.join(counts.filter(F.col("n") < often), "key").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found"))
        out = out.join(left, "uid", "left")
    else:
        out = out.withColumns({"more": F.lit(0.0), "found": F.lit(0)})
    if not whole:
        dear = out.select("uid", F.explode("grams").alias("key")).join(costs.filter(F.col("m") < common), "key")
        out = out.join(dear.groupBy("uid").agg(F.sum("cost").alias("dear")), "uid", "left")
    else:
        out = out.withColumn("dear", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("found", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("dear", F.lit(0.0))).alias("score"),
    )
