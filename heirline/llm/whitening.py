"""Whitening of embeddings: rows on the leading components of their covariance, each scaled to variance 1."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm.eigen import content, from_remainders, needed_primes, null_vectors, polynomials_modulo, Roots
from heirline.llm.integers import Form, coded
from heirline.plans.scratch import Scratch

SCALE = 256
COMPONENTS = 4
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
# Primes in one task.
PRIMES_TOGETHER = 8
LONGEST = (1 << 63) - 1


def whole_products(x: np.ndarray, largest: int) -> np.ndarray:
    """The exact x' x as Python numbers."""
    if len(x) * largest * largest < 1 << 53:
        # Every partial sum is a whole number that a double holds.
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def scatter(fit: DataFrame, form: Form) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * x'x - sums' sums) over the codes, in whole numbers. What reaches the driver depends on the width only."""
    d = form.width
    upper = np.triu_indices(d + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = form.matrix(batch.column(0)).astype(np.int64)
            # With a column of ones, counts and sums are products as well.
            total = total + whole_products(np.hstack([np.ones((len(x), 1), np.int64), x]), form.largest)
        if total[0, 0]:
            sums = [Decimal(int(v)) for v in total[upper]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["i", "j", "v"]
            )

    rows = fit.select("code").mapInArrow(partial, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = {(r.i, r.j): int(r.v) for r in rows.collect()}
    n, sums = total[0, 0], [total[0, j] for j in range(1, d + 1)]
    spread = [[n * total[min(i, j), max(i, j)] - sums[i - 1] * sums[j - 1] for j in range(1, d + 1)] for i in range(1, d + 1)]
    return n, sums, spread


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial, lowest coefficient first. The primes are dealt out to tasks."""
    primes = needed_primes(matrix)
    held = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PRIMES_TOGETHER):
                mine = batch.column(0).slice(at, PRIMES_TOGETHER)
                made = polynomials_modulo(held.value, mine.to_numpy())
                yield pa.RecordBatch.from_arrays([mine, pa.array(list(made), pa.list_(pa.int64()))], ["prime", "remainders"])

    tasks = -(-len(primes) // PRIMES_TOGETHER)
    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks, "prime")
    rows = dealt.mapInArrow(reduce, "prime long, remainders array<long>").collect()
    held.unpersist()
    return from_remainders([r.prime for r in rows], [r.remainders for r in rows])


def components_of(spark: SparkSession, matrix: list[list[int]], count: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of the largest positive eigenvalues in falling order, ``count`` at most."""
    shared = content(matrix)
    if not shared:
        return []
    reduced = [[x // shared for x in line] for line in matrix]
    roots = Roots(characteristic(spark, reduced)).largest(count)
    held = spark.sparkContext.broadcast(reduced)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = null_vectors(held.value, int(a), s, m)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["i", "vectors"])

    asked = spark.createDataFrame([(i, str(a), s, m) for i, (a, s, m) in enumerate(roots)], "i int, a string, s int, m int")
    rows = asked.repartition(len(roots), "i").mapInArrow(solve, "i int, vectors array<array<double>>").collect()
    held.unpersist()
    found = {r.i: r.vectors for r in rows}
    out = [(shared * Fraction(a, 1 << s), list(v)) for i, (a, s, _) in enumerate(roots) for v in found[i]]
    return out[:count]


def whiten(spark: SparkSession, vectors: DataFrame, *, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    A vector x has the components floor(scale * embedding). The covariance is that of the ``n`` different vectors
    with divisor n, so repeated rows do not weigh more; every row is returned, also repeated ones and those
    without a vec_id. ``whitened`` is the centred x on the eigenvector over the root of the eigenvalue, ``explained``
    the eigenvalue's part of the trace, ``deviation`` the exact sum of (n * x - sums)^2 (null beyond the range of long), and
    ``identity_error`` how far the covariance of ``whitened`` is off the identity. Components are numbered from 1 by falling
    eigenvalue; of an eigenvalue that repeats, any orthogonal vectors. There are as many as the rank of the covariance, ``components`` at
    most: none if all vectors are equal, and then no rows; no usable rows give no result either.

    Rows with a null or empty vector, or with null or non-finite components, are dropped, as are vectors of another length than the most
    frequent one. Only vec_id and embedding are read.
    """
    scratch = Scratch(spark)
    made = coded(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale, "vec_id")
    if made is None:
        return spark.createDataFrame([], SCHEMA)
    rows, form = made
    rows = scratch.save(rows, scratch.place("codes")).df
    fit = scratch.save(rows.select("code").distinct(), scratch.place("fit")).df
    n, sums, spread = scatter(fit, form)
    found = components_of(spark, spread, components)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    trace = sum(spread[i][i] for i in range(form.width))
    explained = [float(value / trace) for value, _ in found]
    # (n * x - sums) on the vector, over the root of the eigenvalue of n^2 times the covariance.
    axes = np.array([v for _, v in found]).T
    roots = np.array([_root(value) for value, _ in found])
    big = n * form.largest + max(map(abs, sums))

    def centred(column: pa.Array) -> np.ndarray:
        x = form.matrix(column)
        whole = np.int64 if big < 1 << 62 else object
        return x.astype(whole) * n - np.array(sums, whole)

    def on_axes(moved: np.ndarray) -> np.ndarray:
        return moved.astype(np.float64) @ axes / roots

    k = len(found)
    upper = np.triu_indices(k + 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = on_axes(centred(batch.column(0)))
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"]
        )

    summed = fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = np.zeros(k + 1)
    total = np.zeros((k + 1, k + 1))
    for i, j, v in summed:
        total[i, j] = v / n
        if i == 0:
            mean[j] = v / n
    covered = np.triu(total - np.outer(mean, mean))[1:, 1:]
    error = float(np.abs(covered - np.eye(k)).max())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = centred(batch.column(1))
            squares = form.width * big * big
            if squares <= LONGEST:
                deviation = pa.array((moved * moved).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in line) for line in moved]
                deviation = pa.array([v if v <= LONGEST else None for v in exact], pa.int64())
            many = np.repeat(np.arange(len(batch)), k)
            cells = [batch.column(0).take(pa.array(many)), pa.array(np.tile(np.arange(1, k + 1), len(batch)), pa.int32())]
            cells += [pa.array(np.full(len(many), n)), deviation.take(pa.array(many)), pa.array(on_axes(moved).reshape(-1))]
            cells += [pa.array(np.tile(explained, len(batch))), pa.array(np.full(len(many), error))]
            yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(place, SCHEMA)


def _root(value: Fraction) -> float:
    """The square root, also of numbers beyond the range of doubles."""
    shift = max(0, value.numerator.bit_length() - value.denominator.bit_length() - 1000) // 2 * 2
    return float(value / (1 << shift)) ** 0.5 * 2.0 ** (shift // 2)
