"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Tables are keyed by pairs (i, j) from two small collections of hashes: collection A has ``m`` concatenations
a_1..a_m of ``r`` minima each, B likewise, and table (i, j) is keyed by (a_i, b_j).  So m * m tables of 2r minima
cost 2 * m * r minhashes instead of 2 * m * m * r.  With m = 6, r = 2, a pair of similarity 0.85 shares a key with
probability 0.9991, one of 0.9 with 0.99996.

Links are found in two rounds, neither of which lists all pairs of a bucket:

1. Every set is compared with the least member of each of its buckets.
2. Buckets whose members are still in several components are taken up again.  A member of another component than
   the bucket's largest is compared with all others, save those that counting rules out.  ``frequent`` elements
   are those that over ``RARE`` sets of the round hold.  Two sets without a rare element in common can share no
   more than the smaller number of their frequent elements, so that number must reach the wanted intersection;
   sets with a rare element in common are joined on it, which makes RARE partners an element at most.  Both rules
   are exact.

Every table here grows with the documents, so all joins are sort-merge joins: a broadcast would gather its side on the
driver, whatever the threshold that the session has for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.common import collected, connected_components, cut, discard, merged, picked
from exonloom.llm.shingles import minhashes, shingle_sets, slices

#: An element that more sets hold is frequent.
RARE = 12
#: Bytes of text that are turned into sets at a time.
SLICE = 2_000_000


def _sketches(width: int, m: int, r: int):
    n = 2 * m * r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                sets = shingle_sets(texts[lo:hi], width)
                full = [k for k, s in enumerate(sets) if len(s)]
                mh = np.zeros((len(sets), n), np.uint32)
                if full:
                    mh[full] = minhashes([sets[k] for k in full], n)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                offsets = pa.array(np.arange(0, (len(sets) + 1) * n, n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(mh.view(np.int32).reshape(-1)))],
                    names=["doc", "n", "print", "mh"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                sets = shingle_sets(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = []
            last, was = None, None
            for k in range(batch.num_rows):
                raw = y[k].as_buffer()
                if last is None or not raw.equals(last):
                    last, was = raw, np.frombuffer(raw, np.uint64)
                s = np.frombuffer(x[k].as_buffer(), np.uint64)
                both = np.concatenate((s, was))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    return run


def least_agreement(n: int, percent: int, missed: float = 1e-4) -> int:
    """How many of ``n`` minhashes a pair of similarity ``percent`` / 100 or more shares, but for a part ``missed``."""
    p, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > missed:
            return k
    return n


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _reaches(f: Column, g: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of sizes x and y that share at most the smaller of f and g elements can be similar enough."""
    return F.least(f, g) * (100 + percent) >= (x + y) * percent


def _low_bytes(mh: Column, n: int) -> list[Column]:
    """The last bytes of ``n`` minhashes, eight to a number."""
    byte = lambda k: F.shiftleft(F.element_at(mh, k + 1).bitwiseAND(255).cast("bigint"), 8 * (k % 8))
    return [reduce(Column.bitwiseOR, (byte(k) for k in range(lo, min(lo + 8, n)))) for lo in range(0, n, 8)]


def _may_agree(x: Column, y: Column) -> Column:
    """How many of two numbers' eight bytes are equal."""
    d = x.bitwiseXOR(y)
    for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3F3F3F3F3F3F3F3F), (1, 0x7F7F7F7F7F7F7F7F)):
        d = d.bitwiseOR(F.shiftrightunsigned(d, by).bitwiseAND(F.lit(mask)))
    return 8 - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))


def _buckets(nodes: DataFrame, m: int, r: int) -> DataFrame:
    """(key, table, node, n, lead, lead_n): the members of every bucket that holds several, with its least member."""
    part = lambda lo: F.slice("mh", lo + 1, r)
    tables = F.array(*(F.xxhash64(F.lit(i), F.lit(j), part(i * r), part((m + j) * r)) for i in range(m) for j in range(m)))
    keys = nodes.select("node", "n", F.posexplode(tables).alias("table", "key"))
    lead = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("top")).filter("lead.node < top")
    return cut(keys.join(merged(lead.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))), "key"))


def _undecided(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, table, node, n, component, main): members of buckets that hold several components; main is the largest."""
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    placed = buckets.select("key", "table", "node", "n").join(merged(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(merged(sizes), "component", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    placed = cut(placed)
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("members", "component")).alias("main")).filter("low < high")
    out = cut(placed.drop("members").join(merged(several.select("key", F.col("main.component").alias("main"))), "key"))
    discard(placed)
    return out


def _late_pairs(undecided: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, m: int, r: int) -> DataFrame:
    """(a, b): pairs of different components in a bucket that counting doesn't rule out."""
    c = F.col
    members = undecided.select("node").distinct()
    elements = cut(sets.join(merged(members), "node", "left_semi").mapInArrow(_exploded, "node bigint, element bigint"))
    often = elements.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
    held = cut(elements.join(merged(often), "element"))
    discard(elements)
    # f1: elements that another set has as well; f: those that are frequent
    counts = held.groupBy("node").agg(F.count("*").alias("f1"), F.count_if(c("df") > RARE).alias("f"))
    enough = lambda f: c(f) * (100 + percent) >= c("n") * (F.lit(1) + percent / 100) * percent
    rows = undecided.join(merged(nodes.select("node", "mh")), "node").join(merged(counts), "node").filter(enough("f1"))
    low = _low_bytes(c("mh"), 2 * m * r)
    rows = cut(rows.withColumns({f"low{k}": x for k, x in enumerate(low)}))

    # sets that may share enough frequent elements meet in their buckets; a pair is taken up in the first table that
    # it shares, so that it comes out once
    dense = rows.filter(enough("f"))
    same = F.zip_with("mh_x", "mh_y", lambda p, q: p == q)
    agreed = lambda base: F.array_position(F.array(*(F.forall(F.slice(same, base + 1 + k * r, r), lambda v: v) for k in range(m))), True)
    first = (agreed(0) - 1) * m + agreed(m * r) - 1 == c("table_x")
    least = least_agreement(2 * m * r, percent)
    near = F.size(F.filter(same, lambda v: v)) >= least
    maybe = sum(_may_agree(c(f"low{k}_x"), c(f"low{k}_y")) for k in range(len(low))) >= least + -2 * m * r % 8
    apart = (c("component_x") != c("component_y")) & _fits(c("n_x"), c("n_y"), percent)
    bound = _reaches(c("f_x"), c("f_y"), c("n_x"), c("n_y"), percent)
    through_keys = _side(dense.filter("component != main"), "x").join(merged(_side(dense, "y")), (c("key_x") == c("key_y")) & apart & bound & maybe & first & near)

    # the others meet on a rare element that both hold
    rare = held.filter(c("df") <= RARE).join(merged(rows.select("node", "component", "n", "f1").distinct()), "node")
    bound = _reaches(c("f1_x"), c("f1_y"), c("n_x"), c("n_y"), percent)
    through_rare = _side(rare, "x").join(merged(_side(rare, "y")), (c("element_x") == c("element_y")) & (c("node_x") > c("node_y")) & apart & bound)

    ends = [F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")]
    return through_keys.select(*ends).unionByName(through_rare.select(*ends)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, m: int = 6, r: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word shingles.
    ``component_id`` is the smallest id that a row reaches over links, ``kept`` marks the row that has it.

    Defined results: a null or empty text, or one without words, has n_shingles 0 and is linked with nothing.
    Exact copies, however many, are one set: they are compared with others once.  A repeated row is a copy of
    itself and repeats in the result.  An id with several texts gets, for each row, the component of that row's text.
    A row with a null id joins its copies' component, takes part in no other link, and is kept if that has no id.
    An empty table gives an empty result.  Other columns of ``docs`` are not looked at.
    """
    c = F.col
    base = picked(docs, doc=F.col(f"`{id_col}`").cast("bigint"), text=text_col)
    sigs = cut(base.mapInArrow(_sketches(width, m, r), "doc bigint, n bigint, print binary, mh array<int>"))
    classes = cut(sigs.filter("n > 0").groupBy("print").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.min("mh").alias("mh")))
    nodes = classes.filter("node is not null").select("node", "n", "mh")
    buckets = _buckets(nodes, m, r)
    wanted = buckets.select("node").distinct()
    texts = base.join(merged(wanted), F.col("doc") == F.col("node"), "left_semi").select("doc", "text")
    sets = cut(texts.mapInArrow(_sets(width), "node bigint, elements binary"))
    collected(sets)

    # round 1: every set with the least of each of its buckets
    star = buckets.filter(c("node") != c("lead")).filter(_fits(c("n"), c("lead_n"), percent))
    star = star.select(c("node").alias("a"), c("lead").alias("b")).distinct()
    links = _confirmed(star, nodes, sets, percent, 2 * m * r)
    final = found = connected_components(links)

    # round 2: what is left of buckets with several components
    undecided = _undecided(buckets, found)
    collected(undecided)
    if not undecided.isEmpty():
        late = _confirmed(_late_pairs(undecided, nodes, sets, percent, m, r), nodes, sets, percent, 2 * m * r)
        if not late.isEmpty():
            final = connected_components(found.select(c("node").alias("a"), c("component").alias("b")).unionByName(late))
    for t in (buckets, sets, links, undecided):
        discard(t)
    collected(sigs)
    homes = classes.select("print", "node").join(merged(final), "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = sigs.select("doc", "n", "print").join(merged(homes), "print", "left").withColumn("component_id", F.when(c("n") > 0, c("component")).otherwise(c("doc")))
    return out.select(c("doc").alias(id_col), c("n").alias("n_shingles"), "component_id", c("doc").eqNullSafe(c("component_id")).alias("kept"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices([len(x.as_buffer()) for x in batch.column(1)], SLICE):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)[lo:hi]]
            nodes = np.repeat(batch.column(0)[lo:hi].to_numpy(zero_copy_only=False), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(sets))], names=["node", "element"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Of (a, b), those whose full sets pass.  Pairs that agree in fewer of their ``n`` minima than all but one in
    10,000 pairs of the wanted similarity do are passed over first."""
    x, y = (nodes.select(F.col("node").alias(k), F.col("mh").alias(f"mh_{k}")) for k in "ab")
    agree = F.aggregate(F.zip_with("mh_a", "mh_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    pairs = cut(pairs.join(merged(x), "a").join(merged(y), "b").filter(agree >= least_agreement(n, percent)).select("a", "b"))
    s, t = (sets.select(F.col("node").alias(k), F.col("elements").alias(f"set_{k}")) for k in "ab")
    out = cut(pairs.join(merged(s), "a").join(merged(t), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a bigint, b bigint"))
    discard(pairs)
    collected(out)
    return out
