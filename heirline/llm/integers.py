"""Vectors as whole numbers: cleaned, scaled, and coded in few bytes.

A code holds the numbers of one vector behind each other, all in the narrowest integer type that the whole table
needs. So equal vectors have equal codes, and a batch of codes is read as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From here on doubles no longer hold every whole number.
TOO_LARGE = 1 << 53


@dataclass(frozen=True)
class Form:
    """How many numbers a code has, of which type, and how large they get."""

    width: int
    dtype: str
    largest: int

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The (rows x width) numbers of a column of codes."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            return np.zeros((0, self.width), self.dtype)
        large = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        first = int(np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset])
        size = self.width * np.dtype(self.dtype).itemsize
        return np.frombuffer(data, self.dtype, len(column) * self.width, first).reshape(-1, self.width) if size else np.zeros((len(column), 0))

    def column(self, numbers: np.ndarray) -> pa.Array:
        """The codes of the rows of a matrix."""
        raw = np.ascontiguousarray(numbers.astype(self.dtype))
        size = self.width * raw.dtype.itemsize
        offsets = pa.py_buffer((np.arange(len(raw) + 1, dtype=np.int64) * size).astype(np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, offsets, pa.py_buffer(raw)]).cast(pa.binary())


def finite(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def coded(vectors: DataFrame, scale: int, *kept: str) -> tuple[DataFrame, Form] | None:
    """``kept`` columns and ``code`` of each usable vector, whose components are floor(scale * x); None without any.

    The vectors are in ``embedding``. Those that are null, empty or hold null or non-finite components are left out. Vectors of
    different lengths have no inner product: the most frequent length counts (of several, the largest) and the others
    are left out. Whole numbers of 2^53 or more are refused.
    """
    rows = vectors.select(*kept, F.col("embedding").cast("array<double>").alias("embedding")).filter(finite(F.col("embedding")))
    size = F.array_max(F.transform("embedding", F.abs))
    found = rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    best = found.orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return None
    largest = int(best.size * scale) + 1
    if largest >= TOO_LARGE:
        raise ValueError(f"a component of {best.size} is too large to be scaled by {scale}")
    dtype = next(t for t in ("int8", "int16", "int32", "int64") if largest <= np.iinfo(t).max)
    form = Form(best.width, dtype, largest)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False)
            numbers = np.floor(scale * flat).astype(np.int64).reshape(-1, form.width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], form.column(numbers)], [*kept, "code"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(kept)]) if kept else ""
    schema = f"{types}, code binary" if types else "code binary"
    return rows.filter(F.size("embedding") == form.width).mapInArrow(encode, schema), form
