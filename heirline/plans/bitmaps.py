"""Closures of very many starts at once, as bitmaps.

The starts are numbered and cut into blocks of ``BITS``. A row (vertex, block) tells in its words which starts of the block reach the
vertex, so a sweep carries vertices x blocks rows instead of a row for each pair. Layer by layer, the finished rows of a layer are
pushed along its edges, OR-ed per target, and written by the layer of the target. So every edge and every row is
read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirline.plans.prefix import running_total
from heirline.plans.push import push

WORDS = 16
BITS = 64 * WORDS
WORD_NAMES = [f"w{i}" for i in range(WORDS)]
# Pairs that a task of a listing sorts, some 200 MB.
TASK_PAIRS = 1_000_000


@dataclass(frozen=True)
class Closure:
    """``reached`` (node_id, block, words): the starts from which a vertex is reached over one edge or more.

    ``starts`` (query_id, number) tells which start has which bit: block * BITS + place.
    """

    starts: DataFrame
    reached: DataFrame

    def pairs(self) -> DataFrame:
        """(query_id, node_id) of every set bit."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Some rows at a time: each may hold BITS pairs.
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    row, bit = _set_bits(part, 2)
                    number = part.column(1).to_numpy()[row] * BITS + bit
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number)], ["node_id", "number"])

        rows = self.reached.select("node_id", "block", *WORD_NAMES).mapInArrow(spread, "node_id string, number long")
        return rows.join(self.starts, "number").select("query_id", "node_id")

    def with_starts(self) -> Closure:
        """The same with the starts themselves, each reached from itself. A start that others reach has a further row for its own bit."""
        return Closure(self.starts, self.reached.unionByName(own_words(self.starts, WORD_NAMES)))

    def listed(self, facts: DataFrame, order: list | None) -> DataFrame:
        """(query_id, facts) of every set bit, in the order of query_id and then ``order``, from (node_id, facts). Without an ``order`` nothing is sorted.

        Starts are numbered in their order, so rows of vertices are dealt out to ranges of starts and spread only there: no pair
        is shuffled. A row with the names of its starts leads each word.
        """
        pairs = self.reached.agg(F.sum(sum(F.bit_count(w) for w in WORD_NAMES))).first()[0] or 0
        words = F.array(*[F.struct((F.col("block") * WORDS + i).alias("_group"), F.col(w).alias("_word")) for i, w in enumerate(WORD_NAMES)])
        cut = F.explode(F.filter(words, lambda w: w["_word"] != 0)).alias("_cut")
        rows = self.reached.join(facts, "node_id").select(*facts.columns, cut).select(*facts.columns, "_cut.*")
        named = self.starts.groupBy(F.floor(F.col("number") / 64).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("number", "query_id"))).alias("_names"))
        named = named.select("_group", F.col("_names.query_id").alias("_names"))
        ranged = rows.unionByName(named, allowMissingColumns=True).repartitionByRange(-(-pairs // TASK_PAIRS) or 1, "_group")
        led = Window.partitionBy("_group").orderBy(F.col("_names").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = ranged.withColumn("_names", F.first("_names", ignorenulls=True).over(led)).filter(F.col("_word").isNotNull())
        starts = F.expr("explode(transform(filter(sequence(0, 63), i -> getbit(_word, i) = 1), i -> _names[i]))").alias("query_id")
        rows = known.select(starts, *facts.columns)
        return rows if order is None else rows.sortWithinPartitions("query_id", *order)

    def counts(self, kinds: DataFrame) -> DataFrame:
        """(query_id, kind, n) of the vertices reached of each kind, from (node_id, kind); bits are counted, not listed."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    row, bit = _set_bits(part, 2)
                    coded = part.column(0).dictionary_encode(null_encoding="encode")
                    names, kinds = coded.dictionary.to_pylist(), coded.indices.to_numpy()[row]
                    blocks = part.column(1).to_numpy()[row]
                    for block in np.unique(blocks):
                        for kind in np.unique(kinds[blocks == block]):
                            total = sums.setdefault((names[kind], int(block)), np.zeros(BITS, np.int64))
                            total += np.bincount(bit[(blocks == block) & (kinds == kind)], minlength=BITS)
            for (name, block), total in sums.items():
                at = np.flatnonzero(total)
                cells = [pa.array([name] * len(at), pa.string()), pa.array(block * BITS + at), pa.array(total[at])]
                yield pa.RecordBatch.from_arrays(cells, ["kind", "number", "n"])

        rows = self.reached.join(kinds, "node_id").select("kind", "block", *WORD_NAMES)
        summed = rows.mapInArrow(count, "kind string, number long, n long").groupBy("kind", "number").agg(F.sum("n").alias("n"))
        return summed.join(self.starts, "number").select("query_id", "kind", "n")

    def first(self, ranked: DataFrame, limit: int) -> DataFrame:
        """(query_id, node_id, place) of the ``limit`` vertices of least ``place`` that each start reaches, from (node_id, place).

        A task walks its vertices in order of their places until ``limit`` bits of a start are set, so it passes on no more.
        """

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    rows, bits = _set_bits(part, 3)
                    blocks = part.column(2).to_numpy()[rows]
                    for block in np.unique(blocks):
                        mine = blocks == block
                        row, bit = rows[mine], bits[mine]
                        before = seen.setdefault(int(block), np.zeros(BITS, np.int64))
                        # How often a start was met when its bit comes: before this part, and by earlier rows of it.
                        turn = np.argsort(bit, kind="stable")
                        met = np.bincount(bit, minlength=BITS)
                        held = np.empty(len(bit), np.int64)
                        held[turn] = np.arange(len(bit)) - np.repeat(np.cumsum(met) - met, met)
                        kept = before[bit] + held < limit
                        before += met
                        cells = [part.column(c).take(pa.array(row[kept])) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*cells, pa.array(int(block) * BITS + bit[kept])], ["node_id", "place", "number"])

        rows = self.reached.join(ranked.select("node_id", "place"), "node_id").select("node_id", "place", "block", *WORD_NAMES)
        best = rows.sortWithinPartitions("place").mapInArrow(walk, "node_id string, place long, number long")
        turn = F.row_number().over(Window.partitionBy("number").orderBy("place"))
        best = best.withColumn("_turn", turn).filter(F.col("_turn") <= limit)
        return best.join(self.starts, "number").select("query_id", "node_id", "place")


def _set_bits(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every set bit, row by row, from the words, which begin at column ``first``. Only words with a set bit are unpacked."""
    words = np.stack([batch.column(first + i).to_numpy() for i in range(WORDS)], axis=1) if len(batch) else np.zeros((0, WORDS), np.int64)
    row, word = np.nonzero(words)
    at, bit = np.nonzero(np.unpackbits(words[row, word].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[at], word[at] * 64 + bit


def own_words(starts: DataFrame, names: list[str]) -> DataFrame:
    """(node_id, block, words): the bit of every start, from (query_id, number)."""
    word, bit = F.floor(F.col("number") % BITS / 64), F.expr("shiftleft(1L, cast(number % 64 AS INT))")
    words = [F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(names)]
    return starts.select(F.col("query_id").alias("node_id"), F.floor(F.col("number") / BITS).cast("long").alias("block"), *words)


def is_set(words: str) -> Column:
    """Whether the bit of ``number`` is set in the array ``words`` of its block; no for null."""
    word = f"get({words}, cast(number % {BITS} DIV 64 AS INT))"
    return F.coalesce(F.expr(f"(shiftright({word}, cast(number % 64 AS INT)) & 1) = 1"), F.lit(False))


def closure(graph, ids: DataFrame, direction: str) -> Closure:
    """What is reached from every id (node_id), or reaches it with direction "backward". Unknown ids reach nothing.

    One round per layer, for graphs that :func:`heirline.plans.push.can_push`.
    """
    scratch = graph.scratch
    distinct = ids.select(F.col("node_id").alias("query_id")).distinct()
    numbered = scratch.save(running_total(scratch, distinct, ["query_id"], F.lit(1), "number"), scratch.place("starts"))
    starts = numbered.df
    # Few starts do not fill a block: words without any are not pushed.
    used = WORD_NAMES[: max(1, -(-numbered.rows // 64))]
    own = own_words(starts, used).join(graph.layers, "node_id")
    merged = {w: F.bit_or(w) for w in used}
    reached = push(graph, direction, own.select("node_id", "layer", "block", *used), ["block"], merged)
    empty = [F.lit(0).cast("long").alias(w) for w in WORD_NAMES[len(used) :]]
    return Closure(starts, reached.select("node_id", "block", *used, *empty))
