"""Exact vector search: a stated set of query vectors against all vectors, in parts.

Each part of the vectors is held by one task, as 32-bit floats, and all queries are read past it in blocks, whose matrix
products keep the k best of each query; the best of all parts are ranked per query. Rows are single vectors, so that
neither a row nor a join grows with the tables. Nothing is sent whole to the driver or held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSION = 256
#: Vectors of a part on average, once there are more than ``PARTS`` parts.
PART = 131_072
PARTS = 8
#: Held vectors and queries that are multiplied at a time.
BLOCK = 8192
QUERY_BLOCK = 512
CHILD_K = 100
HELD, ASKS = 0, 1


def usable_vectors(vectors: DataFrame, row: str = "vector_row", vector: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """(vector_row, embedding) of ``dimension`` finite numbers, not all zero; a row delivered twice counts once."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(row).alias("vector_row"), v.cast("array<float>").alias("embedding")).where((F.size(v) == dimension) & good & F.col(row).isNotNull())
    return rows.groupBy("vector_row").agg(F.min("embedding").alias("embedding"))


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cut(asking: np.ndarray, rows: np.ndarray, likeness: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, ties to the smaller row; queries in rising order."""
    order = np.lexsort((rows, -likeness, asking))
    asking = asking[order]
    order = order[np.arange(len(order)) - np.searchsorted(asking, asking) < k]
    return order, rows[order], likeness[order]


class _Best:
    """The k best of a block of queries so far."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.names, self.units, self.k = names, _units(vectors), k
        self.at, self.rows, self.likeness = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, held: np.ndarray, units: np.ndarray) -> None:
        likeness = np.round(self.units @ units.T, 9)
        likeness[self.names[:, None] == held[None, :]] = -np.inf
        # no value under a query's k-th so far, or under its k-th of these, can be among its k best
        least = np.full(len(self.names), -2.0)
        full = np.bincount(self.at, minlength=len(self.names)) >= self.k
        if full.any():
            np.copyto(least, np.inf, where=full)
            np.minimum.at(least, self.at, self.likeness)
        if len(held) > self.k and not full.all():
            least[~full] = np.maximum(-2.0, np.partition(likeness[~full], -self.k, axis=1)[:, -self.k])
        query, place = np.nonzero(likeness >= least[:, None])
        at, rows = np.concatenate([self.at, query]), np.concatenate([self.rows, held[place]])
        order, self.rows, self.likeness = _cut(at, rows, np.concatenate([self.likeness, likeness[query, place]]), self.k)
        self.at = at[order]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.at]), pa.array(self.rows), pa.array(self.likeness)], ["query_row", "vector_row", "similarity"])


def _multiply(k: int, dimension: int):
    """In runs of one part, the k best of each asking row: held rows come first, asking rows are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            part, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if part[a] != last:
                    held, last = [], part[a]
                rows = batch.column(2).slice(a, b - a).to_numpy()
                x = batch.column(3).slice(a, b - a).flatten().to_numpy().reshape(-1, dimension)
                if role[a] == HELD:
                    held += [(rows[i : i + BLOCK], x[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
                    continue
                blocks = [_Best(rows[i : i + QUERY_BLOCK], x[i : i + QUERY_BLOCK], k) for i in range(0, len(rows), QUERY_BLOCK)]
                for names, vectors in held:
                    units = _units(vectors)
                    for block in blocks:
                        block.meet(names, units)
                yield from (block.found() for block in blocks)

    return run


def _parts(vectors: DataFrame) -> int:
    return max(PARTS, -(-vectors.count() // PART))


def _own(parts: int) -> Column:
    return F.pmod(F.xxhash64("vector_row"), F.lit(parts)).cast("int")


def _ranked(met: DataFrame, parts: int, k: int, dimension: int) -> DataFrame:
    """The ``k`` best of each asking row of ``met`` (part, role, row, embedding)."""
    met = met.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role")
    found = met.mapInArrow(_multiply(k, dimension), "query_row bigint, vector_row bigint, similarity double")
    best = Window.partitionBy("query_row").orderBy(F.col("similarity").desc(), "vector_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int = CHILD_K, dimension: int = DIMENSION) -> DataFrame:
    """(query_row, rank, vector_row, similarity): the ``k`` most similar others of each query row, ties to the smaller row."""
    parts = _parts(vectors)
    rows = [F.col("vector_row").cast("bigint").alias("row"), "embedding"]
    held = vectors.select(_own(parts).alias("part"), F.lit(HELD).alias("role"), *rows)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(ASKS).alias("role"), *rows)
    return _ranked(held.unionByName(asked), parts, k, dimension)


def exact_topk_among(vectors: DataFrame, asks: Column, k: int = CHILD_K, dimension: int = DIMENSION) -> DataFrame:
    """``exact_topk`` of the vectors for which ``asks`` holds: one scan serves both roles, so that no two run at a time."""
    parts = _parts(vectors)
    own = F.array(F.struct(_own(parts).alias("part"), F.lit(HELD).alias("role")))
    every = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.lit(ASKS).alias("role")))
    met = vectors.select(F.explode(F.when(asks, F.concat(own, every)).otherwise(own)).alias("to"), F.col("vector_row").cast("bigint").alias("row"), "embedding")
    return _ranked(met.select("to.part", "to.role", "row", "embedding"), parts, k, dimension)
