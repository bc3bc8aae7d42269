"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, reranked exactly.

A hash turns unit vectors by three rounds of random signs and a fast Hadamard transform and takes the signed axis that
a vector is nearest to.  A table's cell is made of several hashes, the last one over fewer axes, so that the number of
cells follows the square root of the number of vectors; a query's cost grows no faster.  A query looks into the
``probes`` cells of each table that its turned coordinates come nearest to, by the sum of the squared gaps.

Neighbouring cells, those that agree in their first hashes, are dealt together as a place; a query goes there once,
with the list of the cells that it probes.  Rows carry vectors of one byte a component, which tell each query's ``KEPT``
best of a place; these alone are looked up and compared by their original vectors.  Of those, a query gives up all that
are surely further than its nearest in a sample of about 4 sqrt(n) vectors, which bounds what can be among its nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.llm.common import cut
from exonloom.llm.vectors import matrix, number_type, packed_vectors, runs, usual_dim

#: Vectors of a block at most, on average, and queries.
BLOCK = 8192
#: Vectors of a place, on average, from which on one hash more is dealt by.
PLACE = 4096
#: Candidates of a query that a block gives out, and that are compared by their original vectors.
KEPT = 24
#: By how much a cosine of vectors of bytes may be off.
SLACK = 0.02
#: One row in so many tells how many there are of a place, for cutting places into blocks.
COUNTED = 16
#: Vectors of the sample at most.
SAMPLE = 16_384
#: Pairs whose products are held at a time.
PAIRS = 1 << 16


class Rotation:
    """Pseudo-random rotations of one seed; dimensions are padded to a power of two."""

    def __init__(self, dim: int, tables: int, seed: int = 7):
        self.size = 1 << max(0, (dim - 1).bit_length())
        self.dim, self.tables = dim, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        """The rows of x after three rounds of signs and Hadamard."""
        y = np.zeros((len(x), self.size))
        y[:, : self.dim] = x
        for s in self.signs[table]:
            y = y * s
            h = 1
            while h < self.size:
                y = y.reshape(len(x), -1, 2, h)
                y = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(len(x), self.size)
                h *= 2
            y /= np.sqrt(self.size)
        return y


class Cells:
    """Tables of concatenated hashes for ``n`` vectors."""

    def __init__(self, dim: int, n: int, tables: int, probes: int, seed: int = 7):
        size = 1 << max(0, (dim - 1).bit_length())
        full = int(math.log2(2 * size))
        bits = max(1, round(math.log2(90 * math.sqrt(max(n, 1)))))
        #: axes of each hash; a hash of m axes has 2 m cells
        self.axes = [size] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])
        #: hashes that make a place
        self.dealt = min(len(self.axes) - 1, next(g for g in range(64) if n / (2 * size) ** g <= PLACE))
        self.dim, self.tables, self.probes = dim, tables, probes
        self.rotation = Rotation(dim, tables * len(self.axes), seed)

    def _signed(self, x: np.ndarray, table: int, hash_: int) -> np.ndarray:
        y = self.rotation.turned(x, table * len(self.axes) + hash_)[:, : self.axes[hash_]]
        return np.concatenate((y, -y), 1)

    def places(self) -> int:
        return math.prod(2 * m for m in self.axes[: self.dealt])

    def _split(self, code: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        inner = math.prod(2 * m for m in self.axes[self.dealt :])
        return table * self.places() + code // inner, code % inner

    def own(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell in it) of each row."""
        code = np.zeros(len(x), np.int64)
        for k, m in enumerate(self.axes):
            code = code * (2 * m) + self._signed(x, table, k).argmax(1)
        return self._split(code, table)

    def probed(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell in it) of the cells that each row probes: a beam over the hashes, which is exact, as a longer
        code's gaps are no smaller than its beginning's."""
        code, gap = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k, m in enumerate(self.axes):
            both = self._signed(x, table, k)
            own = (both.max(1, keepdims=True) - both) ** 2
            code = (code[:, :, None] * (2 * m) + np.arange(2 * m)).reshape(len(x), -1)
            gap = (gap[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            if code.shape[1] > self.probes:
                best = np.argsort(gap, axis=1, kind="stable")[:, : self.probes]
                code, gap = np.take_along_axis(code, best, 1), np.take_along_axis(gap, best, 1)
        return self._split(code, table)


def bytes_of(x: np.ndarray) -> np.ndarray:
    """Rows in one byte a component, scaled by their largest."""
    return np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


_ROW = "place bigint, node bigint, query int, v binary, cells binary, least float"


def _placed(cells: Cells, kind: str, query: int, sample=None, top: int = 1):
    """(node, v) to a row per table, or for queries per place that they probe; ``least`` is a cosine that the query's
    ``top`` nearest others in the broadcast ``sample`` of unit vectors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                x = matrix(some.column(1), kind, cells.dim)
                small = [r.tobytes() for r in bytes_of(x)]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                least = np.full(len(x), -2.0)
                if sample and len(sample.value) > top:
                    # the query itself may be in the sample: one more is asked for
                    least = np.partition(x @ sample.value.T, -top - 1, axis=1)[:, -top - 1] - SLACK
                least = pa.array(least.astype(np.float32))
                for t in range(cells.tables):
                    if query:
                        place, cell = cells.probed(x, t)
                        by = np.lexsort((cell, place), axis=1)
                        place, cell = np.take_along_axis(place, by, 1), np.take_along_axis(cell, by, 1)
                        rows, places, lists = [], [], []
                        for r in range(len(x)):
                            first = np.flatnonzero(np.concatenate(([True], place[r][1:] != place[r][:-1])))
                            rows += [r] * len(first)
                            places += place[r][first].tolist()
                            lists += [c.tobytes() for c in np.split(cell[r].astype(np.int32), first[1:])]
                    else:
                        places, cell = cells.own(x, t)
                        rows, lists = np.arange(len(x)), [c.tobytes() for c in cell.astype(np.int32)]
                    rows = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), some.column(0).take(rows), pa.array(np.full(len(rows), query, np.int32)), pa.array(small, pa.binary()).take(rows), pa.array(lists, pa.binary()), least.take(rows)], names=["place", "node", "query", "v", "cells", "least"])

    return run


def _best(most: int):
    """A block's rows (place, i, j, query, node, v, cells) to each query's ``most`` best, by vectors of bytes.  A query
    without cells looks at all of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            is_query = block.column("query").to_numpy().astype(bool)
            if is_query.all() or not is_query.any():
                continue
            node, cells = block.column("node").to_numpy(), block.column("cells").to_pylist()
            v = np.frombuffer(b"".join(block.column("v").to_pylist()), np.int8).reshape(block.num_rows, -1)
            norm, least = np.linalg.norm(v.astype(np.float32), axis=1), block.column("least").to_numpy()
            c = np.flatnonzero(~is_query)
            home = np.frombuffer(b"".join(cells[k] for k in c), np.int32)
            by = np.argsort(home, kind="stable")
            c, home = c[by], home[by]
            out = []
            for q in np.flatnonzero(is_query).tolist():
                if cells[q]:
                    probed = np.frombuffer(cells[q], np.int32)
                    low, high = np.searchsorted(home, probed), np.searchsorted(home, probed, "right")
                    size = high - low
                    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                else:
                    at = np.arange(len(c))
                own, own_score = np.zeros(0, np.int64), np.zeros(0)
                for lo in range(0, len(at), PAIRS):
                    some = c[at[lo : lo + PAIRS]]
                    score = (v[some].astype(np.float32) @ v[q].astype(np.float32)).astype(float) / (norm[some] * norm[q])
                    near = score >= least[q]
                    own, own_score = np.append(own, some[near]), np.append(own_score, score[near])
                    if len(own) > most:
                        keep = np.lexsort((node[own], -own_score))[:most]
                        own, own_score = own[keep], own_score[keep]
                out.append((np.full(len(own), node[q]), node[own], own_score))
            q, found, score = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(score)], names=["q", "c", "score"])

    return run


def _parts(counted: DataFrame, name: str, of: int) -> DataFrame:
    """(place, name): into how many parts places are cut, from the rows of one node in ``of``."""
    return counted.groupBy("place").agg(F.ceil(F.count("*") * of / BLOCK).cast("int").alias(name)).filter(F.col(name) > 1)


def _compared(m: DataFrame, q: DataFrame, m_parts: DataFrame, q_parts: DataFrame) -> DataFrame:
    """(q, c, score) of the best in every place of members ``m`` and queries ``q``; a place with over BLOCK of
    either is cut into parts, and each part of its members meets each of its queries."""
    hot = m_parts.join(q_parts, "place", "full").select("place", *(F.coalesce(c, F.lit(1)).alias(c) for c in ("i_parts", "j_parts")))
    both = m.unionByName(q).join(hot, "place", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("i_parts", "j_parts")})
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("node"), F.col(c)).cast("int"))
    is_query = F.col("query") == 1
    both = both.withColumn("i", F.explode(F.when(is_query, every("i_parts")).otherwise(own("i_parts"))))
    both = both.withColumn("j", F.explode(F.when(is_query, own("j_parts")).otherwise(every("j_parts"))))
    both = both.select("place", "i", "j", "query", "node", "v", "cells", "least").repartition("place", "i", "j").sortWithinPartitions("place", "i", "j", "query", "node")
    found = both.mapInArrow(_best(KEPT), "q bigint, c bigint, score double")
    return found.groupBy("q", "c").agg(F.max("score").alias("score"))


def _exact(kind: str, dim: int):
    """(q, c, v, w) to (q, c, score) by the original vectors, sum by sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                x, y = (matrix(some.column(k), kind, dim) for k in (2, 3))
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(score)], names=["q", "c", "score"])

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, top: int = 5, tables: int = 12, probes: int = 192) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` vectors of largest cosine found for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller id.  Equal vectors are searched for once and looked up together, so a vector that a third of the rows
    hold costs no more than one; of its ids, the top + 1 smallest can be anyone's nearest, and only they go on.
    A query that finds fewer than ``top`` is compared with all rows, block by block.

    Defined results: vectors that are null, zero, or hold a component that is null or not finite take no part, nor do
    null ids, nor vectors of another than the commonest length.  A repeated id counts once, with the vector whose
    hash is least.  An empty table gives an empty result.
    """
    kind = number_type(df, vec_col)
    packed = packed_vectors(df, id_col, vec_col)
    dim = usual_dim(packed)
    usable = packed.filter((F.col("dim") == dim) & (F.col("dim") > 0) & F.col("vec").isNotNull())
    asks = (F.col("vec") % every) == 0
    # equal vectors are one node, named by their least id
    rows = cut(usable.groupBy("vec").agg(F.min("print").alias("print")))
    nodes = cut(rows.groupBy("print").agg(F.min("vec").alias("node"), F.max(asks).alias("asks")))
    own = usable.select(F.col("vec").alias("node"), "print", "v").join(nodes, ["node", "print"])
    members = cut(own.groupBy("node").agg(F.min("v").alias("v"), F.max("asks").alias("asks")))
    ids = rows.join(nodes.select("print", "node"), "print").select("node", "vec")
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec"))
    low = cut(ids.withColumn("place", place).filter(F.col("place") <= top + 1).select("node", "vec"))
    n, total = members.count(), rows.count()
    cells = Cells(max(dim, 1), n, tables, probes)
    queries = members.filter("asks").select("node", "v")
    some = members.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, 4 * math.isqrt(n))).select("v").collect()
    some = np.frombuffer(b"".join(bytes(r["v"]) for r in some), kind).reshape(-1, max(dim, 1)).astype("f8")
    sample = df.sparkSession.sparkContext.broadcast(some / np.linalg.norm(some, axis=1, keepdims=True))
    placed = lambda df, query: df.select("node", "v").mapInArrow(_placed(cells, kind, query, sample if query else None, top), _ROW)
    counted = lambda df: df.filter(F.pmod(F.xxhash64("node", F.lit("count")), F.lit(COUNTED)) == 0)
    parts = _parts(placed(counted(members), 0), "i_parts", COUNTED), _parts(placed(counted(queries), 1), "j_parts", COUNTED)
    found = cut(_compared(placed(members, 0), placed(queries, 1), *map(cut, parts)))

    short = found.join(low.withColumnRenamed("node", "c"), "c").groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") < min(top + 1, total))
    short = queries.join(short, queries["node"] == short["q"], "left_semi")
    if not short.isEmpty():
        blocks = max(1, math.ceil(n / BLOCK))
        one = Cells(max(dim, 1), 1, 1, 1)
        of_block = lambda df, c: df.withColumn("place", c)
        m = of_block(members.select("node", "v").mapInArrow(_placed(one, kind, 0), _ROW), F.pmod(F.xxhash64("node"), F.lit(blocks)))
        q = of_block(short.mapInArrow(_placed(one, kind, 1), _ROW).dropDuplicates(["node"]).withColumn("cells", F.lit(b"")), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        found = cut(found.unionByName(_compared(m, q, *map(cut, (_parts(m, "i_parts", 1), _parts(q, "j_parts", 1))))).groupBy("q", "c").agg(F.max("score").alias("score")))

    ranked = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *order))
    found = found.withColumn("place", ranked("q", "c")).filter(F.col("place") <= KEPT).select("q", "c")
    vectors = lambda name, v: members.select(F.col("node").alias(name), F.col("v").alias(v))
    found = found.join(vectors("q", "x"), "q").join(vectors("c", "y"), "c").select("q", "c", "x", "y").mapInArrow(_exact(kind, max(dim, 1)), "q bigint, c bigint, score double")
    found = found.withColumn("place", ranked("q", "c")).filter(F.col("place") <= top + 1)
    wide = found.join(low.withColumnRenamed("node", "c"), "c").select("q", "vec", "score")
    wide = wide.withColumn("place", ranked("q", "vec")).filter(F.col("place") <= top + 1).select("q", "vec", "score")
    pairs = ids.filter(asks).select(F.col("vec").alias("query_id"), F.col("node").alias("q")).join(wide, "q").filter(F.col("vec") != F.col("query_id"))
    out = pairs.withColumn("rank", ranked("query_id", "vec")).filter(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")
