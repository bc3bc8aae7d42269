"""Vectors as rows: validity, distinct vectors, and runs of rows that share a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.common import cut


def number_type(df: DataFrame, col: str) -> str:
    """numpy type in which the column's numbers are held exactly."""
    return "<f4" if df.schema[col].dataType.elementType.simpleString() == "float" else "<f8"


def packed_vectors(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(vec: bigint, print: binary, v: binary, dim, more...) per row; v is null if the vector is null, zero, or holds a
    component that is null or not finite.  Equal vectors have equal prints."""
    kind = number_type(df, vec_col)
    base = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec"), F.col(f"`{vec_col}`").alias("raw"), *more)
    schema = ", ".join(["vec bigint", "print binary", "v binary", "dim int", *(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, vs, dims = [], [], []
            for x in batch.column(1):
                x = x.as_py()
                v = np.array(x, "f8") if x and None not in x else np.zeros(0)
                good = len(v) and np.isfinite(v).all() and 0 < np.linalg.norm(v) < np.inf
                data = v.astype(kind).tobytes() if good else None
                vs.append(data)
                prints.append(xxhash.xxh3_128_digest(data) if good else None)
                dims.append(len(v) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(vs, pa.binary()), pa.array(dims, pa.int32()), *batch.columns[2:]], schema=None, names=["vec", "print", "v", "dim", *batch.schema.names[2:]])

    return cut(base.mapInArrow(run, schema))


def usual_dim(packed: DataFrame) -> int:
    """The commonest length of valid vectors, the larger one at a tie; 0 if there is none."""
    row = packed.filter("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return row["dim"] if row else 0


def matrix(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype("f8") if len(column) else np.zeros((0, dim))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of neighbouring rows that agree in the first ``keys`` columns, which are integers without nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)], 1)
        edges = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *edges.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
