"""Text quality: logistic regression on hashed word n-grams, trained by FTRL.

Words are runs of letters and digits, or of punctuation, with their case; features are single
words and pairs of neighbours, hashed into a fixed number of slots. A text is a sparse vector of unit
length. Training follows the regularised leader (FTRL-Proximal) over a bounded sample of
labelled rows; scoring is a sparse dot product with weights of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import words as W

SLOTS = 1 << 18
# At most so many labelled rows are learned from, those with the smallest hashes of their id.
SAMPLE_ROWS = 12_000


@dataclass(frozen=True)
class Rule:
    """FTRL-Proximal with per-slot rates; ``passes`` over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    passes: int = 4


def features(column: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, slot, value): the sparse unit vector of every text, slots in order."""
    found = W.find_words(column, W.MARKED, lower=False)
    counts = found.counts
    pair_first, pairs = W.shingles(found, 2)
    # A word that follows itself is one feature, whatever the word.
    at = np.repeat(found.first[:-1] - pair_first[:-1], np.diff(pair_first)) + np.arange(pair_first[-1])
    after = np.minimum(at + 1, np.repeat(found.first[1:], np.diff(pair_first)) - 1)
    pairs = np.where((found.hash[at] == found.hash[after]) & (at < after), np.uint64(1), pairs)
    owner = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), np.diff(pair_first))])
    slot = np.concatenate([found.hash, pairs]) % np.uint64(slots)
    keys, n = np.unique(owner.astype(np.uint64) * np.uint64(slots) + slot, return_counts=True)
    owner, slot = (keys // np.uint64(slots)).astype(np.int64), (keys % np.uint64(slots)).astype(np.int32)
    value = np.log1p(n)
    length = np.sqrt(np.bincount(owner, value * value, len(counts)))
    first = np.searchsorted(owner, np.arange(len(counts) + 1))
    return first, slot, (value / length[owner]).astype(np.float32)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, rule: Rule) -> np.ndarray:
    """Weights per slot, the last one for the constant; rows: (slots, values, label)."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * rule.l1 - z[i]
        return np.where(np.abs(z[i]) <= rule.l1, 0.0, shrunk / ((rule.beta + np.sqrt(n[i])) / rule.alpha + rule.l2))

    for turn in range(rule.passes):
        for k in np.random.default_rng(turn).permutation(len(rows)):
            slot, value, label = rows[k]
            i, x = np.append(slot, slots), np.append(value, 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rule.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(slots + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, slots: int = SLOTS, sample_rows: int = SAMPLE_ROWS, rule: Rule = Rule()) -> np.ndarray:
    """Weights from the texts of ``docs`` and their ``labels`` (doc_id, label 0 or 1).

    At most ``sample_rows`` labelled rows take part, those with the smallest hashes of their id;
    only their vectors meet in one task. Rows without an id, or a label other than 0 or 1, teach nothing; without any
    row the weights are all zero, so every score is one half. Of contradicting labels the smaller counts.
    """
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # The limit bounds what is broadcast; texts that are not in the sample are not shuffled.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = texts.join(F.broadcast(sample), texts["doc_id"] == sample["_id"]).select("doc_id", "text", "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                first, slot, value = features(batch.column(1).slice(a, b - a), slots)
                ends = pa.array(first.astype(np.int32))
                made = [pa.ListArray.from_arrays(ends, pa.array(slot)), pa.ListArray.from_arrays(ends, pa.array(value))]
                rest = [batch.column(i).slice(a, b - a) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*rest, *made], ["doc_id", "label", "slots", "vector"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            slot, value = batch.column("slots"), batch.column("vector")
            ends, label = slot.offsets.to_numpy(), batch.column("label").to_numpy()
            s, v = slot.values.to_numpy(), value.values.to_numpy()
            rows += [(s[a:b].copy(), v[a:b].copy(), int(y)) for a, b, y in zip(ends[:-1], ends[1:], label, strict=True)]
        weights = learn(rows, slots, rule) if rows else np.zeros(slots + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["weights"])

    vector = chosen.mapInArrow(vectors, "doc_id long, label int, slots array<int>, vector array<float>")
    ordered = vector.repartition(1).sortWithinPartitions("doc_id", "slots")
    found = ordered.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros(slots + 1, np.float32)


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name``. Null and empty texts get that of the constant."""
    shared = spark.sparkContext.broadcast(weights)

    def rate(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value.astype(np.float64)
        slots = len(w) - 1
        for column in parts:
            out = []
            for a, b in W.slices(column):
                first, slot, value = features(column.slice(a, b - a), slots)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                margin = np.bincount(owner, w[slot] * value, b - a) + w[-1]
                out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
            yield pa.array(np.concatenate(out or [np.zeros(0)]))

    rated = F.arrow_udf(rate, "double")
    return docs.withColumn(name, rated(F.col("text").cast("string")))
