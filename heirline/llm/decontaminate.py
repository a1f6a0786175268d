"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Every window of a document that is as long as a benchmark item has a 64-bit fingerprint. Items
whose fingerprint lies within a radius are found by blocks: if two fingerprints differ in at most
``RADIUS`` bits, then in one of ``BLOCKS`` blocks they differ in at most ``RADIUS // BLOCKS``, and all
such variants of the items' blocks are in the index. What is found is verified by the exact weighted Jaccard
similarity of shingles, the weight of a shingle being how often it occurs. Windows without any
shingle of an item of their size have similarity 0 and get no fingerprint.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import words as W
from heirline.plans.scratch import Scratch

SHINGLE_WORDS = 5
PERCENT = 80
# At a similarity of 0.8 fingerprints differ in about 10 bits, with a deviation of 3.
RADIUS = 20
BLOCKS = 7
# Bytes of item texts that are searched in one pass over the documents.
ITEM_BYTES = 4 << 20
# Places of a text whose sums are in memory at once, beside those of one window.
PLACES = 1 << 13
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 sums of +1 and -1."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(W.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


class SizeClass:
    """The items of one number of words."""

    def __init__(self, span: int, radius: int, blocks: int):
        self.span, self.radius = span, radius
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        ends = np.linspace(0, 64, blocks + 1).astype(int)
        self.cuts = [(int(a), (1 << int(b - a)) - 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def add(self, item: int, hashes: np.ndarray) -> None:
        self.ids.append(item)
        self.sets.append(np.sort(hashes))

    def close(self) -> None:
        self.prints = fingerprints(np.stack([signs(s).sum(axis=0) for s in self.sets]))
        self.tables = []
        near = self.radius // len(self.cuts)
        for shift, mask in self.cuts:
            bits = range(mask.bit_length())
            flips = [sum(1 << b for b in c) for k in range(near + 1) for c in combinations(bits, k)]
            keys = ((self.prints >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
            keys = keys[:, None] ^ np.array(flips, np.int64)[None, :]
            owner = np.repeat(np.arange(len(keys)), len(flips))
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.tables.append((keys.reshape(-1)[order], owner[order]))

    def near(self, prints: np.ndarray) -> np.ndarray:
        """(window, item) rows of all items whose fingerprint is within the radius."""
        found = []
        for (shift, mask), (keys, owner) in zip(self.cuts, self.tables, strict=True):
            own = ((prints >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            count = high - low
            place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            found.append(np.repeat(np.arange(len(prints)), count) * len(self.ids) + owner[place])
        pairs = np.unique(np.concatenate(found))
        pairs = np.stack([pairs // len(self.ids), pairs % len(self.ids)], axis=1)
        apart = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]])
        return pairs[apart <= self.radius]


def shared_weight(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the smaller counts of what both sorted multisets hold."""
    values, counts = np.unique(a, return_counts=True)
    other = np.searchsorted(b, values, "right") - np.searchsorted(b, values)
    return int(np.minimum(counts, other).sum())


class ItemIndex:
    """The items of a benchmark, or of a part of it, in size classes."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, percent: int, radius: int, blocks: int):
        self.n, self.percent = n, percent
        self.classes: dict[int, SizeClass] = {}
        found = W.find_words(pa.array([t for _, t in items], pa.string()), W.ALNUM)
        vocabulary = defaultdict(list)
        for size in {min(n, int(c)) for c in found.counts if c}:
            first, hashes = W.shingles(found, size)
            for i, count in enumerate(found.counts):
                if count and min(n, count) == size:
                    own = self.classes.setdefault(int(count), SizeClass(int(count) - size + 1, radius, blocks))
                    own.add(items[i][0], hashes[first[i] : first[i + 1]])
                    vocabulary[size].append((int(count), hashes[first[i] : first[i + 1]]))
        for own in self.classes.values():
            own.close()
        # Per shingle size: sorted shingles with the size class that holds each.
        self.known = {}
        for size, parts in vocabulary.items():
            keys = np.concatenate([h for _, h in parts])
            of = np.concatenate([np.full(len(h), c) for c, h in parts])
            pairs = np.unique(np.stack([keys, of.astype(np.uint64)], axis=1), axis=0)
            filled = np.zeros(1 << 20, bool)
            filled[(pairs[:, 0] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.known[size] = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), filled

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): the best window of every item that a row leaks."""
        found = W.find_words(column, W.ALNUM)
        best: dict[tuple[int, int], tuple] = {}
        for size, (keys, of, filled) in self.known.items():
            first, hashes = W.shingles(found, size)
            at = np.flatnonzero(filled[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], "right")
            count = high - low
            place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at, of_at = np.repeat(at, count), of[place]
            row = np.searchsorted(first, at, "right") - 1
            # Hits of one row and size class lie behind each other.
            order = np.lexsort((at, of_at, row))
            at, of_at, row = at[order], of_at[order], row[order]
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(of_at) != 0)) + 1
            for hits in np.split(np.arange(len(at)), cuts):
                if len(hits):
                    r, words = int(row[hits[0]]), int(of_at[hits[0]])
                    self._windows(best, r, words, hashes[first[r] : first[r + 1]], at[hits] - first[r], int(found.counts[r]))
        return [(r, item, start, n, s) for (r, item), (s, start, n) in sorted(best.items())]

    def _windows(self, best: dict, row: int, words: int, hashes: np.ndarray, hits: np.ndarray, count: int) -> None:
        own = self.classes[words]
        span = min(own.span, len(hashes))
        low, high = np.maximum(hits - span + 1, 0), np.minimum(hits, len(hashes) - span)
        mark = np.zeros(len(hashes) + 2, np.int32)
        np.add.at(mark, low, 1)
        np.add.at(mark, high + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark) > 0)
        # Sums for some thousand places at a time, whatever the length of the text.
        at = 0
        while at < len(starts):
            begin = int(starts[at])
            part = starts[at : int(np.searchsorted(starts, begin + PLACES))]
            at += len(part)
            end = int(part[-1]) + span
            totals = np.zeros((end - begin + 1, 64), np.int32)
            np.cumsum(signs(hashes[begin:end]), axis=0, out=totals[1:])
            prints = fingerprints(totals[part - begin + span] - totals[part - begin])
            for window, i in own.near(prints).tolist():
                start = int(part[window])
                words_in, item = hashes[start : start + span], own.sets[i]
                shared = shared_weight(words_in, item)
                whole = len(words_in) + len(item) - shared
                if 100 * shared >= self.percent * whole:
                    key, now = (row, own.ids[i]), (shared / whole, start, min(words, count))
                    if key not in best or (now[0], -now[1]) > (best[key][0], -best[key][1]):
                        best[key] = now


def item_parts(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of about ``limit`` bytes of text."""
    part, size = [], 0
    for item, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        part.append((item, text))
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def leaks(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    n: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each item that a document leaks.

    Words are letters and digits, A-Z lowered. A window has as many words as the item, or is the whole document if
    that is shorter; an item of fewer than ``n`` words is one shingle. Null or empty items and
    documents leak nothing. Repeated rows are reported each; of equal windows the first counts. Only
    doc_id, item_id and text are read. A benchmark is searched in parts of bounded size, one pass over the documents each.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts, found = item_parts(items), []
    part, following = next(parts, None), next(parts, None)
    if following is None:
        shared = spark.sparkContext.broadcast(part or [])
        return _leaks_of(narrow, shared, n, percent, radius, blocks) if part else spark.createDataFrame([], FOUND)
    # One part is held and broadcast at a time; its result is written.
    scratch = Scratch(spark)
    while part is not None:
        shared = spark.sparkContext.broadcast(part)
        found.append(scratch.save(_leaks_of(narrow, shared, n, percent, radius, blocks), scratch.place("leaks")).df)
        shared.destroy()
        part, following = following, next(parts, None)
    return reduce(DataFrame.unionByName, found)


def _leaks_of(docs: DataFrame, shared, n: int, percent: int, radius: int, blocks: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, n, percent, radius, blocks)
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            rows = [(a + r, *rest) for a, b in W.slices(column) for r, *rest in index.search(column.slice(a, b - a))]
            at, item, start, count, similarity = zip(*rows, strict=True) if rows else ((),) * 5
            made = [names.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64())]
            made += [pa.array(count, pa.int64()), pa.array(similarity, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return docs.mapInArrow(search, FOUND)
