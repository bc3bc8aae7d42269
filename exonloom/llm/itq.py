"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables, confirmed on original vectors.

ITQ learns, on a bounded sample, rotations of the principal axes under which the signs of the coordinates are a
balanced code close to the coordinates themselves.  The codes of several rotations, one after the other, are cut into
substrings, each of which keys a table, and a sketch of SKETCH bits.  How many bits a substring has follows from the
number of vectors, without a bound, and how many tables there are from the share of pairs at the threshold that may be
missed: bits of vectors at angle a differ with probability a / pi.

Tables are met in two steps.  First only ids and codes are dealt by table and substring, and vectors whose sketch is
within the threshold's Hamming radius of another's in their bucket are marked; vectors without a near one go no further.
Then the marked ones' vectors are dealt the same way and compared by their cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm.common import connected_components, cut
from exonloom.llm.vectors import matrix, number_type, packed_vectors, runs, usual_dim

#: Vectors that the rotations are learned from at most.
SAMPLE = 20_000
#: Vectors of a block at most, on average.
BLOCK = 1024


#: Bits of a sketch, in 64-bit words.
SKETCH = 128


@dataclass
class Codes:
    """Rotations; code() gives a row's substrings, one per table, and sketch() its last bits."""

    turns: np.ndarray  # rotation x dim x dim
    bits: int
    tables: int

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit rows to row x table integers of ``bits`` bits, and row x 2 words of the sketch."""
        signs = np.concatenate([unit @ t for t in self.turns], 1) > 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        codes = np.stack([signs[:, k * self.bits : (k + 1) * self.bits] @ weights for k in range(self.tables)], 1).astype(np.int64)
        last = signs[:, self.bits * self.tables :][:, :SKETCH]
        return codes, np.packbits(last, 1).view(np.uint64)


def plan(n: int, cosine: float, missed: float = 0.005, bucket: int = 512) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors in the largest group: buckets of about ``bucket``, however large n is."""
    bits = max(0, round(math.log2(max(n, 1) / bucket)))
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - same)) if same < 1 else 1)


def radius(cosine: float, deviations: float = 5.0) -> int:
    """Bits of a sketch that vectors at the threshold may differ in: the mean and ``deviations`` standard deviations."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(SKETCH * p + deviations * math.sqrt(SKETCH * p * (1 - p)))


def learned(sample: np.ndarray, bits: int, tables: int, steps: int = 30, seed: int = 11) -> Codes:
    """Principal axes, then alternately the codes nearest to the turned rows and the rotation nearest to the codes.

    Rows aren't centred: bits split by planes through the origin, so that near rows agree in them by their angle alone,
    also where most rows are copies around one point.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample + 1e-12 * np.eye(dim))[1][:, ::-1]
    y, turns = sample @ axes, []
    for _ in range(math.ceil((bits * tables + SKETCH) / dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(steps):
            b = np.where(y @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(b.T @ y)
            r = (u @ vt).T
        turns.append(axes @ r)
    return Codes(np.array(turns), bits, tables)


def _coded(codes: Codes, kind: str, dim: int):
    """(label, node, size, v) to the same with the substrings and the sketch, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                x = matrix(some.column(3), kind, dim)
                c, sketch = codes.code(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(c.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in sketch], pa.binary())], names=["label", "node", "size", "v", "codes", "sketch"])

    return run


def _ends(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of either side of a block: its part i and its part j, which are the same if i = j."""
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    part = block.column("part").to_numpy()
    return np.flatnonzero(part == i), np.flatnonzero(part == j)


def _marked(most: int):
    """Blocks (table, label, code, i, j) to (node) of rows that have another one's sketch within ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 5):
            p, q = _ends(block)
            sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            node, near = block.column("node").to_numpy(), np.zeros(block.num_rows, bool)
            for lo in range(0, len(p), 512):
                some = p[lo : lo + 512]
                away = sum(np.bitwise_count(sketch[some, k][:, None] ^ sketch[q, k][None]).astype(np.int16) for k in range(sketch.shape[1]))
                close = (away <= most) & (node[some][:, None] != node[q][None])
                near[some] |= close.any(1)
                near[q] |= close.any(0)
            if near.any():
                yield pa.RecordBatch.from_arrays([*(block.column(c).combine_chunks().filter(pa.array(near)) for c in ("table", "label", "code", "node"))], names=["table", "label", "code", "node"])

    return run


#: Cosines of a matrix product that are no further from the threshold are taken again, sum by sum.
DOUBT = 1e-9


def _linked(kind: str, dim: int, cosine: float):
    """Blocks (table, label, code, i, j) to (node, links, root): each node's links that this table is the first to see,
    and a node of its component among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 5):
            if block.num_rows < 2:
                continue
            t = block.column("table")[0].as_py()
            node, size = block.column("node").to_numpy(), block.column("size").to_numpy()
            raw = matrix(block.column("v"), kind, dim)
            norm = np.linalg.norm(raw, axis=1)
            x = raw / norm[:, None]
            codes = np.array(block.column("codes").to_pylist(), np.int64)
            p, q = _ends(block)
            near = x[p] @ x[q].T
            a, b = np.nonzero(near >= cosine - DOUBT)
            sure = near[a, b] > cosine + DOUBT
            a, b = p[a], q[b]
            # the product's last bits depend on the block's shape; a link must not
            sure[~sure] = (raw[a[~sure]] * raw[b[~sure]]).sum(1) / (norm[a[~sure]] * norm[b[~sure]]) >= cosine
            if block.column("i")[0].as_py() == block.column("j")[0].as_py():
                sure &= a < b
            new = sure & ~(codes[a, :t] == codes[b, :t]).any(1)
            a, b = a[new], b[new]
            if not len(a):
                continue
            links = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
            root = np.arange(len(node))
            while True:
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
                if (root == before).all():
                    break
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on].astype(np.int64)), pa.array(node[root[on]])], names=["node", "links", "root"])

    return run


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a bucket (table, label, code) side by side, cut into blocks: buckets of over BLOCK rows are cut into
    parts, and a part meets itself and every other part of its bucket once."""
    key = ["table", "label", "code"]
    hot = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return rows.select(*key, "i", "j", "part", "node", *more).repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "node")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Rows are linked if their labels are equal and not null and their vectors' cosine, in double precision, is
    ``cosine`` or more.  ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that
    links reach, ``kept`` marks the row that has it.  Equal vectors of a label are compared with others once; what
    leaves a block is a count and one edge per vector, never its pairs.

    Defined results: a null label, or a vector that is null, zero, of another than the commonest length, or holds a
    component that is null or not finite, links with nothing: n_links 0, its own component, kept.  So does a null id.
    A repeated row is another vector with the same id.  An empty table gives an empty result.
    """
    kind = number_type(df, vec_col)
    packed = packed_vectors(df, id_col, vec_col, F.when(F.col(f"`{label_col}`").isNotNull(), F.xxhash64(F.col(f"`{label_col}`"))).alias("label"))
    dim = usual_dim(packed)
    valid = (F.col("dim") == dim) & (F.col("dim") > 0) & F.col("vec").isNotNull() & F.col("label").isNotNull()
    nodes = cut(packed.filter(valid).groupBy("label", "print").agg(F.min("vec").alias("node"), F.count("*").alias("size"), F.min("v").alias("v")))
    groups = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = nodes.orderBy(F.xxhash64("print"), "print").limit(SAMPLE).select("v").collect()
    unit = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), kind).reshape(-1, max(dim, 1)).astype("f8")
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    bits, tables = plan(groups, cosine)
    codes = learned(unit, bits, tables)

    coded = cut(nodes.select("label", "node", "size", "v").mapInArrow(_coded(codes, kind, max(dim, 1)), "label bigint, node bigint, size bigint, v binary, codes array<bigint>, sketch binary"))
    keyed = coded.select("label", "node", "sketch", F.posexplode("codes").alias("table", "code"))
    marked = _blocks(keyed, "sketch").mapInArrow(_marked(radius(cosine)), "table int, label bigint, code bigint, node bigint")
    marked = cut(marked.distinct())
    near = marked.join(coded.select("node", "size", "v", "codes"), "node")
    found = cut(_blocks(near, "size", "v", "codes").mapInArrow(_linked(kind, max(dim, 1), cosine), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    homes = nodes.select("label", "print", "node", "size").join(links, "node", "left").join(components, "node", "left")
    homes = homes.select("label", "print", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    usable = packed.filter(valid).select("vec", "label", "print").join(homes, ["label", "print"]).select("vec", "n_links", "component_id")
    rest = packed.filter(~F.coalesce(valid, F.lit(False))).select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id"))
    out = usable.unionByName(rest)
    return out.select(F.col("vec").alias(id_col), "n_links", "component_id", F.col("vec").eqNullSafe(F.col("component_id")).alias("kept"))
