"""Nearest vectors by largest inner product: an inverted multi-index.

Vectors are cut into two halves, each with centroids of its own. A vector lies in the cell of its two
nearest centroids. A query ranks the centroids of each half by inner product and walks the pairs in the order of
their sums with a heap, until the sum has fallen by a slack below the best. The entries of the visited cells
are ranked by exact inner products. Centroids and slack are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from heirline.plans.scratch import Scratch

NEIGHBOURS = 20
# Vectors from which the centroids and the slack are fitted, those with the smallest hashes of their id.
SAMPLE_ROWS = 16_000
# Part of the true neighbours within the sample that the slack must reach.
REACH = 0.97
# At least so many entries are visited for each neighbour wanted.
LEAST_VISITED = 100
# Entries, and queries, that meet in one group.
BLOCK_ROWS = 4096
MOST_CENTROIDS = 512
# Walks in one task.
WALKS_TOGETHER = 128


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves, and how far below the best sum cells are visited, per length of the query."""

    centroids: tuple[np.ndarray, np.ndarray]
    slack: float

    @property
    def cut(self) -> int:
        return self.centroids[0].shape[1]

    @property
    def width(self) -> int:
        return self.cut + self.centroids[1].shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors x 2) nearest centroids of the halves."""
        halves = vectors[:, : self.cut], vectors[:, self.cut :]
        return np.stack([_nearest(h, c) for h, c in zip(halves, self.centroids, strict=True)], axis=1)

    def sums(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries[:, : self.cut] @ self.centroids[0].T, queries[:, self.cut :] @ self.centroids[1].T


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def _centroids(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Lloyd's rounds from an evenly spaced start; a centroid without members stays."""
    start = x[np.linspace(0, len(x) - 1, k).astype(int)]
    centroids = np.unique(start, axis=0)
    for _ in range(turns):
        near = _nearest(x, centroids)
        n = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def fit(sample: np.ndarray, k: int, neighbours: int = NEIGHBOURS, reach: float = REACH) -> MultiIndex:
    """Centroids of the halves, and the slack that reaches that part of the neighbours of some sample rows."""
    cut = sample.shape[1] // 2
    index = MultiIndex((_centroids(sample[:, :cut], k), _centroids(sample[:, cut:], k)), 0.0)
    queries = sample[:: max(1, len(sample) // 256)]
    scores = queries @ sample.T
    best = np.argsort(-scores, axis=1, kind="stable")[:, : neighbours + 1]
    cells = index.cells(sample)
    left, right = index.sums(queries)
    rows = np.arange(len(queries))[:, None]
    reached = left[rows, cells[best, 0]] + right[rows, cells[best, 1]]
    fall = (left.max(axis=1) + right.max(axis=1))[:, None] - reached
    return MultiIndex(index.centroids, float(np.quantile(fall / np.linalg.norm(queries, axis=1)[:, None], reach)))


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, slack: float, least: int) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by falling sum of their scores, until ``slack`` below the best and ``least`` entries."""
    by_left, by_right = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
    a, b = left[by_left].tolist(), right[by_right].tolist()
    best, seen = a[0] + b[0], 0
    heap = [(-best, 0, 0)]
    while heap:
        fallen, i, j = heapq.heappop(heap)
        if best + fallen > slack and seen >= least:
            return
        pair = by_left[i], by_right[j]
        seen += int(counts[pair])
        yield pair
        # Each pair has one predecessor: along the first row, or from the row above.
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(
    spark: SparkSession, vectors: DataFrame, queries: Column, *, k: int = NEIGHBOURS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row of ``vectors`` that ``queries`` holds for.

    Nearest is the largest inner product; ties go to the smaller vec_id, and ranks start at 1. All rows with another id than the
    query's are candidates; if there are fewer than ``k``, all are returned. Rows without an id take no part, nor do vectors that are null, zero,
    with null or non-finite components, or of another length than most of the sample. Repeated rows are
    candidates each; of queries with one id, the smallest vector is asked. Only vec_id and embedding are read. No usable rows give no result.
    """
    scratch = Scratch(spark)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()["embedding"]
    schema = "query_id long, rank int, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], schema)
    widths, times = np.unique(sample.map(len), return_counts=True)
    width = int(widths[::-1][np.argmax(times[::-1])])
    sample = np.stack([v for v in sample if len(v) == width])
    vectors = vectors.filter(F.size("embedding") == width)
    total = vectors.count()
    centroids = min(MOST_CENTROIDS, 2 ** max(2, round(np.log2(max(total, 1) / 16) / 2)), len(sample))
    index = fit(sample, centroids, k) if width > 1 else fit(np.hstack([sample, 0 * sample]), centroids, k)
    return _search(scratch, vectors, queries, index, k, width)


def _search(scratch: Scratch, vectors: DataFrame, queries: Column, index: MultiIndex, k: int, width: int) -> DataFrame:
    def halves(x: np.ndarray) -> np.ndarray:
        return x if index.width == width else np.hstack([x, 0 * x])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(halves(_matrix(batch.column(1), width))) if len(batch) else np.zeros((0, 2), int)
            made = [*batch.columns, pa.array(cells[:, 0], pa.int32()), pa.array(cells[:, 1], pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "embedding", "row", "cell"])

    schema = "vec_id long, embedding array<double>, row int, cell int"
    entries = scratch.save(vectors.mapInArrow(place, schema), scratch.place("entries")).df
    shape = len(index.centroids[0]), len(index.centroids[1])
    # One number per cell, a table of bounded size.
    counts = np.zeros(shape, np.int64)
    for row, cell, n in entries.groupBy("row", "cell").agg(F.count(F.lit(1))).collect():
        counts[row, cell] = n
    blocks = np.maximum(1, -(-counts.sum(axis=1) // BLOCK_ROWS))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), width)
            slack = index.slack * np.linalg.norm(x, axis=1)
            left, right = index.sums(halves(x))
            at, rows, cells = [], [], []
            for i in range(len(x)):
                mine: dict[int, list[int]] = {}
                for row, cell in walk(left[i], right[i], counts, slack[i], LEAST_VISITED * k):
                    if counts[row, cell]:
                        mine.setdefault(row, []).append(cell)
                at += [i] * len(mine)
                rows += mine.keys()
                cells += mine.values()
            taken = batch.take(pa.array(at, pa.int64()))
            made = [*taken.columns, pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, ["query_id", "query", "row", "cells"])

    asked = entries.filter(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.save(asked, scratch.place("asked"))
    # Few rows, but each is a walk: no tasks are merged.
    asked = asked.df.repartition(max(1, -(-asked.rows // WALKS_TOGETHER)), "vec_id").mapInArrow(visit, "query_id long, query array<double>, row int, cells array<int>")
    asked = scratch.save(asked, scratch.place("visits")).df
    shares = {r: -(-n // BLOCK_ROWS) for r, n in asked.groupBy("row").agg(F.count(F.lit(1))).collect()}
    share = np.array([shares.get(r, 1) for r in range(shape[0])])

    # Entries and queries of one row of cells meet in groups of bounded size.
    def dealt(id_column: str, numbers: np.ndarray) -> Column:
        parts = F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("row") + 1)
        return F.pmod(F.xxhash64(id_column), parts.cast("long")).cast("int")

    def every(numbers: np.ndarray) -> Column:
        parts = F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("row") + 1)
        return F.explode(F.sequence(F.lit(0), parts - 1))

    held = entries.withColumn("block", dealt("vec_id", blocks)).withColumn("share", every(share))
    wanted = asked.withColumn("share", dealt("query_id", share)).withColumn("block", every(blocks))
    found = wanted.groupBy("row", "block", "share").cogroup(held.groupBy("row", "block", "share")).applyInPandas(
        lambda q, e: _best_of_group(q, e, k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best_of_group(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best entries of each query among the cells that it visits."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(asked) and len(held):
        held = held.sort_values(["cell", "vec_id"], kind="stable")
        x, ids, cell = np.stack(held["embedding"]), held["vec_id"].to_numpy(), held["cell"].to_numpy()
        present, begin = np.unique(cell, return_index=True)
        end = np.append(begin[1:], len(cell))
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            q, names = np.stack(part["query"]), part["query_id"].to_numpy()
            visits = np.zeros((len(part), int(present[-1]) + 1), bool)
            for i, cells in enumerate(part["cells"]):
                visits[i, cells[cells <= present[-1]]] = True
            scores = np.full((len(part), len(x)), -np.inf)
            for c, a, b in zip(present, begin, end, strict=True):
                rows = np.flatnonzero(visits[:, c])
                scores[rows, a:b] = q[rows] @ x[a:b].T
            scores[names[:, None] == ids[None, :]] = -np.inf
            if len(x) > k:
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            else:
                least = np.full(len(part), -np.inf)
            for i in range(len(part)):
                # Rounding of the product must not decide between equal vectors, so near ties stay in.
                near = np.flatnonzero((scores[i] > -np.inf) & (scores[i] >= least[i] - 1e-9 * (1 + abs(least[i]))))
                exact = (x[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:k]
                out["query_id"].append(np.full(len(best), names[i]))
                out["vec_id"].append(ids[near[best]])
                out["score"].append(exact[best])
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()})
