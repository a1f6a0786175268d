"""Packing of token sequences by bounded-space online best fit.

Every partition of the input keeps a fixed number of open windows. A document goes whole into
the window that it fills best. If none holds it, the fullest window is topped up with the head
of the document, emitted full, and the rest is placed on. At the end a partition joins its open windows to full
ones; what then remains, less than a window per partition, is merged over all partitions by
running totals. The last remainder is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heirline.llm import words as W
from heirline.llm.tokens import SLICE_BYTES, encoder_of, prepared
from heirline.plans.scratch import Scratch

WINDOW_TOKENS = 4096
OPEN_WINDOWS = 32
END_ID = 2
ID_BYTES = 4
PIECE = "doc_id long, start long, length long, doc_tokens long, part int, window long, offset long, ids binary"


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, most_open: int):
        self.size = size
        self.most_open = most_open
        self.fills: list[int] = []
        self.pieces: list[list[tuple]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Place a document; yields the windows that it fills."""
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [(doc_id, at, total, ids[at : at + self.size])]
            at += self.size
        while at < total:
            rest = total - at
            best = max((i for i, f in enumerate(self.fills) if f + rest <= self.size), key=self.fills.__getitem__, default=None)
            if best is None and len(self.fills) < self.most_open:
                best = len(self.fills)
                self.fills.append(0)
                self.pieces.append([])
            if best is None:
                best = max(range(len(self.fills)), key=self.fills.__getitem__)
                rest = self.size - self.fills[best]
            self.pieces[best].append((doc_id, at, total, ids[at : at + rest].copy()))
            self.fills[best] += rest
            at += rest
            if self.fills[best] == self.size:
                self.fills.pop(best)
                yield self.pieces.pop(best)

    def close(self) -> tuple[list[list[tuple]], list[tuple]]:
        """Join the open windows, fullest first: full windows, and the pieces that remain."""
        order = sorted(range(len(self.fills)), key=lambda i: -self.fills[i])
        full, now, fill = [], [], 0
        for doc_id, start, total, ids in (p for i in order for p in self.pieces[i]):
            while len(ids):
                take = min(len(ids), self.size - fill)
                now.append((doc_id, start, total, ids[:take]))
                start, ids, fill = start + take, ids[take:], fill + take
                if fill == self.size:
                    full.append(now)
                    now, fill = [], 0
        return full, now


def pieces_table(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (piece, part, window, offset)."""
    length = np.array([len(p[3]) for p, *_ in rows], np.int64)
    flat = np.concatenate([p[3] for p, *_ in rows]).astype("<u4")
    ends = np.concatenate([[0], np.cumsum(length) * ID_BYTES]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    whole = [
        pa.array([p[0] for p, *_ in rows], pa.int64()),
        pa.array([p[1] for p, *_ in rows], pa.int64()),
        pa.array(length),
        pa.array([p[2] for p, *_ in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.int64()),
        pa.array([r[3] for r in rows], pa.int64()),
        ids,
    ]
    return pa.RecordBatch.from_arrays(whole, ["doc_id", "start", "length", "doc_tokens", "part", "window", "offset", "ids"])


def placed(window: list[tuple], part: int, number: int) -> Iterator[tuple]:
    offset = 0
    for piece in window:
        yield piece, part, number, offset
        offset += len(piece[3])


def power_cuts(rest: int) -> list[int]:
    """Starts of the power-of-two sequences, largest first, that ``rest`` tokens are cut into."""
    starts, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return starts


def pack(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    *,
    size: int = WINDOW_TOKENS,
    most_open: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of full sequences.

    Every id of every document, ``end_id`` behind each included, lies in exactly one piece. All sequences
    have ``size`` ids but the last few, whose lengths are powers of two. ``ids`` is binary, four bytes a little-endian id. A null text
    is empty and has only ``end_id``; repeated rows are packed each; an empty table gives no rows. Only
    doc_id and text are read.
    """
    shared = spark.sparkContext.broadcast(prepared(path))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        part = TaskContext.get().partitionId()
        packer = Packer(size, most_open)
        number, out, held = 0, [], 0
        for batch in batches:
            column, names = batch.column(1), batch.column(0).to_pylist()
            for a, b in W.slices(column, SLICE_BYTES):
                first, flat = encoder.ids(column.slice(a, b - a))
                for i in range(b - a):
                    ids = np.append(flat[first[i] : first[i + 1]], np.uint32(end_id))
                    for window in packer.add(names[a + i], ids):
                        out += placed(window, part, number)
                        number, held = number + 1, held + size
                if held > SLICE_BYTES:
                    yield pieces_table(out)
                    out, held = [], 0
        full, rest = packer.close()
        for window in full:
            out += placed(window, part, number)
            number += 1
        out += placed(rest, part, -1)
        if out:
            yield pieces_table(out)
        # The worker lives on for other tasks, which need the memory.
        encoder.forget()

    scratch = Scratch(spark)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # What is left of a partition must not change between its readers, so the pieces are written.
    pieces = scratch.save(narrow.mapInArrow(fill, PIECE), scratch.place("pieces")).df
    return merged(pieces, size)


def merged(pieces: DataFrame, size: int) -> DataFrame:
    """Number the sequences and merge what the partitions have left (window -1)."""
    left = F.col("window") < 0
    parts = pieces.groupBy("part").agg(
        F.coalesce(F.max(F.when(~left, F.col("window") + 1)), F.lit(0)).alias("sequences"),
        F.coalesce(F.sum(F.when(left, F.col("length"))), F.lit(0)).alias("tokens"),
    )
    # One row per input partition, less than a window of tokens each.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "part",
        F.coalesce(F.sum("sequences").over(earlier), F.lit(0)).alias("first_sequence"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("first_token"),
    )
    total = parts.agg(F.sum("sequences"), F.sum("tokens")).first()
    sequences, tokens = total[0] or 0, total[1] or 0
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    known = pieces.filter(~left).join(F.broadcast(bases), "part")
    known = known.withColumn("sequence_id", F.col("first_sequence") + F.col("window")).select(*columns)

    whole = tokens // size
    tail = whole * size
    ends = [tail + s for s in power_cuts(tokens - tail)]
    cuts = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>")
    rest = pieces.filter(left).join(F.broadcast(bases), "part")
    rest = rest.withColumn("_from", F.col("first_token") + F.col("offset")).withColumn("_to", F.col("_from") + F.col("length"))
    # A piece is shorter than a window, so it meets one multiple of the size at most.
    next_multiple = (F.floor(F.col("_from") / size) + 1) * size
    starts = F.array_sort(
        F.array_distinct(
            F.concat(
                F.array("_from"),
                F.filter(F.concat(F.array(next_multiple.cast("long")), cuts), lambda c: (c > F.col("_from")) & (c < F.col("_to"))),
            )
        )
    )
    rest = rest.withColumn("_starts", starts).select("*", F.posexplode("_starts").alias("_n", "_at"))
    until = F.coalesce(F.get("_starts", F.col("_n") + 1), F.col("_to"))
    skipped = F.col("_at") - F.col("_from")
    in_tail = F.size(F.filter(cuts, lambda c: c <= F.col("_at")))
    number = F.when(F.col("_at") < tail, F.floor(F.col("_at") / size)).otherwise(F.lit(whole) + in_tail - 1)
    begin = F.when(F.col("_at") < tail, F.floor(F.col("_at") / size) * size).otherwise(F.element_at(cuts, F.greatest(in_tail, F.lit(1))) if ends else F.lit(tail))
    late = rest.select(
        "doc_id",
        (F.col("start") + skipped).alias("start"),
        (until - F.col("_at")).alias("length"),
        "doc_tokens",
        (F.lit(sequences) + number).cast("long").alias("sequence_id"),
        (F.col("_at") - begin).cast("long").alias("offset"),
        F.col("ids").substr((skipped * ID_BYTES + 1).cast("int"), ((until - F.col("_at")) * ID_BYTES).cast("int")).alias("ids"),
    )
    return known.unionByName(late)
