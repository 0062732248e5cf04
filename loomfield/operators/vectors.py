"""Vectors against a set of queries that grows with them: products of blocks, and the best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; a task holds the products of two blocks at once.
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _packed(rows: DataFrame, id_col: str, vec: str, name: str) -> DataFrame:
    """(`name`_ids, `name`_v, n): blocks of up to BLOCK vectors, as bytes; null ids and vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                ids = np.asarray(part.column(0), dtype=np.int64)
                order = np.argsort(ids, kind="stable")
                ids, values = ids[order], _matrix(part.column(1))[order]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_v"])

    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return held.mapInArrow(run, f"{name}_ids binary, {name}_v binary")


def block_products(vectors: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int | None = None, least: float | None = None, but_self: bool = True) -> DataFrame:
    """(query, id, sim) of every query with every vector, sim rounded to six places: all, those of `least` or more, or the `k` best
    of each query within a block of vectors (ties by id), of which the best of all are a part.

    Vectors and queries are packed into blocks; a task multiplies two blocks at a time, so a pair costs a few multiplications and
    with `k` no pair is a row. The blocks of queries go to all tasks; their number grows with the queries. All vectors have one length.
    """
    n = vectors.sparkSession.sparkContext.defaultParallelism
    left = _packed(vectors, id_col, vec, "x")
    right = _packed(queries.repartition(max(1, n // 4)), id_col, vec, "q")
    pairs = left.crossJoin(F.broadcast(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x_ids, x_v, q_ids, q_v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, names = np.frombuffer(x_ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, q = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((x_v, ids), (q_v, names)))
                for begin in range(0, len(names), 64):
                    own = names[begin : begin + 64]
                    sims = _round(q[begin : begin + 64] @ x.T)
                    keep = own[:, None] != ids[None, :] if but_self else np.ones(sims.shape, bool)
                    if least is not None:
                        keep &= sims >= least
                    if k is not None and len(ids) > k:
                        held = np.where(keep, sims, -np.inf)
                        last = -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]
                        above, level = held > last, held == last
                        # Of those equal to the k-th, the first by id: a block is in the order of its ids.
                        keep &= above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(sims[i, j])], ["query", "id", "sim"])

    return pairs.mapInArrow(run, "query long, id long, sim double")


def _round(values: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero, as SQL rounds."""
    return np.sign(values) * np.floor(np.abs(values) * 1e6 + 0.5) / 1e6 + 0.0
