"""Exact searches by inner product over integer vectors that lie in blocks of falling length.

Rows are ranged by length, and each range is a block of about as many rows. A query meets the blocks whose
longest row, times its own length, reaches the score that it needs. In a block, buckets of rows of similar length
are met one after the other. The score needed, over both lengths, is a cosine that a row of the bucket must reach. It
gives every coordinate of the unit vectors a feasible range. A bucket holds a sorted list of each coordinate, and the rows in the ranges of
a few focus coordinates, those where the query is largest, are intersected. Where the cosine is so low
that the ranges hold most of the bucket, a row's length alone is asked for. What is left is verified by exact products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirline.llm.integers import Form
from heirline.plans.scratch import Scratch, Stored

# A block has at most so many numbers, and rows.
BLOCK_NUMBERS = 1 << 22
BLOCK_ROWS = 1 << 16
# Smaller tables have smaller blocks, so that there is work for many tasks.
LEAST_BLOCK_ROWS = 4096
BLOCKS_WANTED = 256
BUCKET_ROWS = 2048
# Rows of a bucket are at least so long as a part of its longest.
BUCKET_RATIO = 0.9
FOCUS = 3
# Coordinates are used if the narrowest range holds less than this part of the bucket.
NARROW = 0.25
# Scores in memory at once.
SCORES_TOGETHER = 1 << 21
# Ranges are widened by this for the rounding of unit vectors.
SLACK = 1e-6


def least_copies(rows: DataFrame, same: list[str], count: int) -> DataFrame:
    """Of rows with equal ``same`` columns only the ``count`` smallest vec_id.

    No search for fewer best rows returns any other. Tasks drop theirs before the shuffle, so copies make no hot group.
    """
    order = Window.partitionBy(*same).orderBy("vec_id")
    return rows.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= count).drop("_copy")


@dataclass(frozen=True)
class Blocks:
    """Rows (vec_id, code, label, block); block numbers go up as lengths fall. ``longest`` is the longest row of each."""

    rows: DataFrame
    longest: np.ndarray
    block_rows: int
    form: Form
    scratch: Scratch

    def reached(self, least: Column, length: Column) -> Column:
        """How many blocks have a row that reaches the score ``least`` with a query of this length.

        The longest lengths, which are looked up, are one number per block.
        """
        rising = self.longest[::-1]

        def count(needed: pa.Array) -> pa.Array:
            return pa.array(len(rising) - np.searchsorted(rising, needed.to_numpy(zero_copy_only=False)), pa.int32())

        needed = least / F.greatest(length, F.lit(1e-300)) * (1 - SLACK)
        return F.arrow_udf(count, "int")(F.when(least > 0, needed).otherwise(0.0))


def lengths(rows: DataFrame, form: Form) -> DataFrame:
    """``rows`` with a ``length`` that is not below the true one."""

    def measure(codes: pa.Array) -> pa.Array:
        x = form.matrix(codes).astype(np.float64)
        return pa.array(np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12))

    return rows.withColumn("length", F.arrow_udf(measure, "double")(F.col("code")))


def into_blocks(scratch: Scratch, rows: DataFrame, form: Form) -> Blocks:
    """Range the rows (vec_id, code, label) by falling length and id, so that equal lengths are split as well."""
    kept = scratch.save(lengths(rows, form), scratch.place("rows"))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // form.width, max(LEAST_BLOCK_ROWS, kept.rows // BLOCKS_WANTED)))
    parts = max(1, -(-kept.rows // block_rows))
    ranged = kept.df.repartitionByRange(parts, F.desc("length"), F.col("vec_id")).withColumn("_range", F.spark_partition_id())
    stored = scratch.save(ranged, scratch.place("blocks")).df
    found = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy("_range").collect()
    # Ranges that follow each other make a block as long as it stays small. There is one row per range here.
    longest, numbers, held = [], [], block_rows
    for r in found:
        if held + r.n > block_rows:
            longest.append(r.longest)
            held = 0
        held += r.n
        numbers.append((r["_range"], len(longest) - 1))
    places = rows.sparkSession.createDataFrame(numbers, "_range int, block int")
    return Blocks(stored.drop("length").join(places, "_range").drop("_range"), np.array(longest), block_rows, form, scratch)


FOUND = "query_id long, slot int, vec_id long, score long"


def _meet(blocks: Blocks, asked: Stored, begin: int, end: int, k: int, match: str | None) -> DataFrame:
    """The best rows of the blocks from ``begin`` to ``end`` for every query that reaches them.

    Queries of a block are dealt in shares of about as many rows as a block has, so that groups have a bounded size.
    """
    form = blocks.form
    shares = max(1, -(-asked.rows // blocks.block_rows))
    last = F.least(F.col("reach"), F.lit(end)) - 1
    queries = asked.df.filter(last >= begin).withColumn("block", F.explode(F.sequence(F.lit(begin), last)))
    queries = queries.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares).cast("long")).cast("int"))
    held = blocks.rows.filter((F.col("block") >= begin) & (F.col("block") < end))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], ["query_id", "slot", "vec_id", "score"])
        q, v = q.combine_chunks(), v.combine_chunks()
        q_ids = q["query_id"].to_numpy()
        low, high = (np.array(q[c].to_pylist(), np.float64).reshape(len(q), -1) for c in ("low", "high"))
        labels = None
        if match:
            names = pd.factorize(np.concatenate([q["label"].to_numpy(), v["label"].to_numpy()]))[0]
            labels = names[: len(q)], names[len(q) :]
        found = search_rows(form.matrix(q["code"]), q_ids, form.matrix(v["code"]), v["vec_id"].to_numpy(), low, high, k, labels, match)
        made = [q_ids[found[0]], found[1].astype(np.int32), found[3], -found[2]]
        return pa.table([pa.array(c) for c in made], ["query_id", "slot", "vec_id", "score"])

    # A number of partitions of one's own: rows are few but each group is much work, so none are merged.
    tasks = min(20_000, 2 * shares * (end - begin))
    sides = [side.repartition(tasks, "block", "share").groupBy("block", "share") for side in (queries, held)]
    return sides[0].cogroup(sides[1]).applyInArrow(search, FOUND)


def best_rows(blocks: Blocks, asked: DataFrame, k: int, match: str | None = None) -> DataFrame:
    """(query_id, slot, vec_id, score, rank): the ``k`` best rows of every query and slot, ranked from 1.

    ``asked`` holds (query_id, code, length, label, low, high); ``low`` and ``high`` are arrays with the limits of each
    slot. Best is the largest inner product, then the smallest vec_id; rows with the query's own id are left out. With
    ``match`` "same" only rows of the same label count, with "other" only those of another. All queries meet the first
    block; the scores they reach there tell which other blocks can hold any better row.
    """
    scratch = blocks.scratch
    first = scratch.save(asked.withColumn("reach", F.lit(1)), scratch.place("asked"))
    found = scratch.save(_meet(blocks, first, 0, min(1, len(blocks.longest)), k, match), scratch.place("found")).df
    if len(blocks.longest) > 1:
        full = found.groupBy("query_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        known = full.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("known")[i].cast("double"), x)))
        rest = first.df.drop("reach").join(known, "query_id", "left").withColumn("low", raised).drop("known")
        rest = rest.withColumn("reach", blocks.reached(F.array_min("low"), F.col("length")))
        rest = scratch.save(rest.filter(F.col("reach") > 1), scratch.place("asked"), figures={"reach": F.max("reach")})
        if rest.rows:
            further = _meet(blocks, rest, 1, rest.figures["reach"], k, match)
            found = found.unionByName(scratch.save(further, scratch.place("found")).df)
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def queries_of(rows: DataFrame, wanted: Column, form: Form) -> DataFrame:
    """(query_id, code, length, label) of the rows (vec_id, code, label) that are asked for; of one id the smallest code and label."""
    chosen = rows.filter(wanted & F.col("vec_id").isNotNull())
    one = chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("code", "label")).alias("r"))
    return lengths(one.select("query_id", "r.code", "r.label"), form)


@dataclass
class Best:
    """The best rows so far of each query and slot, and the score that a further one needs."""

    k: int
    least: np.ndarray
    parts: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, query: np.ndarray, slot: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(query):
            self.parts.append(np.stack([query, slot, -score, ids[row]]))
            self.held += len(query)

    def settle(self) -> np.ndarray:
        """Rows (query, slot, -score, id) in order, ``k`` per query and slot."""
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        all_ = np.concatenate(self.parts, axis=1)
        all_ = all_[:, np.lexsort(all_[::-1])]
        key = all_[0] * self.least.shape[1] + all_[1]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.r_[begin, len(key)]))
        last = rank == self.k - 1
        at = all_[0][last], all_[1][last]
        self.least[at] = np.maximum(self.least[at], -all_[2][last])
        all_ = all_[:, rank < self.k]
        self.parts, self.held = [all_], all_.shape[1]
        return all_


def search_rows(
    queries: np.ndarray,
    query_ids: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    k: int,
    labels: tuple[np.ndarray, np.ndarray] | None = None,
    match: str | None = None,
) -> np.ndarray:
    """Rows (query, slot, -score, id): the ``k`` best rows of every query and slot whose score is in [low, high] of the slot.

    ``queries`` and ``rows`` are whole numbers. Best is the largest inner product, then the smallest id. A query does not
    find its own id; with ``match``, only rows whose label is the "same" or an "other".
    """
    q, v = queries.astype(np.float64), rows.astype(np.float64)
    q_length, v_length = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    # The fastest type in which no sum is rounded; a partial sum is at most the product of the lengths.
    bound = q_length.max(initial=0) * v_length.max(initial=0) * 1.001
    if bound >= 1 << 53:
        raise OverflowError("inner products beyond 2^53 are not supported")
    kind = np.float32 if bound < 1 << 24 else np.float64
    order = np.lexsort((ids, -v_length))
    v, v_length, ids, exact_v, exact_q = v[order], v_length[order], ids[order], rows[order].astype(kind), queries.astype(kind)
    row_labels = labels[1][order] if labels else None
    unit = q / np.maximum(q_length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    best = Best(k, low.astype(np.float64))
    limit = 4 * k * low.size + (1 << 20)

    def verify(asked: np.ndarray, places: np.ndarray) -> None:
        """Give ``best`` the rows whose exact score is good enough."""
        score = (exact_q[asked] @ exact_v[places].T).astype(np.float64)
        fits = query_ids[asked][:, None] != ids[places][None, :]
        if labels:
            same = labels[0][asked][:, None] == row_labels[places][None, :]
            fits &= same if match == "same" else ~same
        for slot in range(low.shape[1]):
            inside = fits & (score >= best.least[asked, slot][:, None]) & (score <= high[asked, slot][:, None])
            if len(places) > k and np.count_nonzero(inside) > 2 * k * len(asked):
                # So many fit that the k-th best of them is worth knowing first.
                kth = -np.partition(np.where(inside, -score, np.inf), k - 1, axis=1)[:, k - 1]
                best.least[asked, slot] = np.maximum(best.least[asked, slot], kth)
                inside &= score >= best.least[asked, slot][:, None]
            i, j = np.nonzero(inside)
            best.add(asked[i], np.full(len(i), slot), places[j], score[i, j].astype(np.int64), ids)

    at = 0
    while at < len(v):
        end = min(at + BUCKET_ROWS, int(np.searchsorted(-v_length, -BUCKET_RATIO * v_length[at], "right")))
        # The lowest score that any slot of the query needs, as a cosine within this bucket.
        needed = best.least.min(axis=1)
        positive = needed > 0
        cosine = np.full(len(q), -1.0)
        cosine[positive] = needed[positive] / np.maximum(q_length[positive] * v_length[at], 1e-300)
        alive = np.flatnonzero(cosine <= 1 + SLACK)
        if len(alive):
            bucket = v[at:end] / np.maximum(v_length[at:end], 1e-300)[:, None]
            dense, found = _by_coordinate(unit[alive], focus[alive], cosine[alive], bucket)
            for i, near in zip(alive[~dense].tolist(), found, strict=True):
                if len(near):
                    verify(np.array([i]), at + near)
            wide = alive[dense]
            if len(wide):
                # By length alone: rows too short for all of these queries are left out.
                shortest = np.where(positive[wide], needed[wide] / np.maximum(q_length[wide], 1e-300), 0).min() * (1 - SLACK)
                stop = at + int(np.searchsorted(-v_length[at:end], -shortest, "right"))
                step = max(1, SCORES_TOGETHER // max(1, stop - at))
                for some in range(0, len(wide), step) if stop > at else ():
                    verify(wide[some : some + step], np.arange(at, stop))
            if best.held > limit:
                best.settle()
        at = end
    return best.settle()


def _by_coordinate(
    unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray, bucket: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which queries leave coordinates aside, and for each of the others the rows of the bucket in all of its ranges.

    Of two unit vectors with at least this cosine, a coordinate of the one is q, so that of the other lies within
    q * cosine -+ sqrt((1 - q^2) (1 - cosine^2)), and up to 1 where q is beyond the cosine.
    """
    n = len(bucket)
    dense = np.ones(len(unit), bool)
    maybe = np.flatnonzero(cosine > 0)
    if not len(maybe) or n < 16:
        return dense, []
    c = np.minimum(cosine[maybe], 1.0)[:, None]
    q = np.take_along_axis(unit[maybe], focus[maybe], axis=1)
    spread = np.sqrt(np.maximum(0, 1 - q * q) * (1 - c * c))
    lower = np.where(q <= -c, -1.0, q * c - spread) - SLACK
    upper = np.where(q >= c, 1.0, q * c + spread) + SLACK
    # Sorted lists of the coordinates that any query looks at.
    lists = {f: np.argsort(bucket[:, f], kind="stable") for f in np.unique(focus[maybe]).tolist()}
    begin, end = np.zeros(q.shape, np.int64), np.zeros(q.shape, np.int64)
    for f, rows in lists.items():
        at = np.nonzero(focus[maybe] == f)
        values = bucket[rows, f]
        begin[at] = np.searchsorted(values, lower[at])
        end[at] = np.searchsorted(values, upper[at], "right")
    sizes = end - begin
    narrow = sizes.min(axis=1) <= NARROW * n
    found = []
    for i in np.flatnonzero(narrow).tolist():
        by_size = np.argsort(sizes[i], kind="stable")
        f = by_size[0]
        near = lists[focus[maybe[i], f]][begin[i, f] : end[i, f]]
        for f in by_size[1:]:
            values = bucket[near, focus[maybe[i], f]]
            near = near[(values >= lower[i, f]) & (values <= upper[i, f])]
        found.append(np.sort(near))
    dense[maybe[narrow]] = False
    return dense, found
