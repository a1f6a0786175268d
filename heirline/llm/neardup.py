"""Near-duplicate documents: SuperMinHash signatures, banding, verification and grouping.

A document is the set of its word shingles. Documents with equal sets form a class, and only one
of each class goes on. Signatures are cut into bands; classes that agree on a band meet in a
bucket. No bucket emits all its pairs: its members are first compared with one of them, and what is
not yet in one group is compared further only where the shingles it shares with any other allow a link.
Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import words as W
from heirline.llm.components import components
from heirline.plans.scratch import Scratch, Stored

SHINGLE_WORDS = 5
PERCENT = 80
# Two sets with a similarity of 0.8 miss each other in all bands with a chance of 3e-6.
BANDS = 32
BAND_ROWS = 5
# Rounds in which the members of a bucket meet one of them, before the rest meets in pairs.
STAR_ROUNDS = 1
# Documents of a cluster that have a rare shingle, at most.
RARE = 64
# Comparisons with one document in one task.
SHARE = 512
# Members of one bucket in one task.
BUCKET_SHARE = 1024
# Rests of hashed ids that are told apart before texts are shuffled.
RESTS = 1 << 19


def superminhash(first: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Signatures (sets x size): the least rank that any element of the set gives each register.

    An element gives register p[j], of a random permutation p of its own, the rank j + u with u in
    [0, 1): ranks of one element are correlated, which lowers the variance. All elements of all sets take step j
    together; a set stops once no later step can lower any of its registers.
    """
    sets = len(first) - 1
    owner = np.repeat(np.arange(sets), np.diff(first))
    ranks = np.full((sets, size), np.inf)
    flat = ranks.reshape(-1)
    alive = np.arange(len(values))
    order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint32), (len(values), 1))
    for j in range(size):
        if not len(alive):
            break
        drawn = W.mix(values[alive] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        place = order[alive, swap]
        order[alive, swap] = order[alive, j]
        # 32 bits of the draw are the fraction, the other 32 choose the place.
        rank = j + (drawn >> np.uint64(32)).astype(np.float64) * 2.0**-32
        np.minimum.at(flat, owner[alive] * size + place, rank)
        open_sets = ranks.max(axis=1) >= j + 1
        alive = alive[open_sets[owner[alive]]]
    return ranks


def band_keys(ranks: np.ndarray, bands: int) -> np.ndarray:
    """(sets x bands) hashes of the bands, different between bands."""
    rows = ranks.shape[1] // bands
    parts = ranks.view(np.uint64).reshape(len(ranks), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(ranks), 1))
    for r in range(rows):
        keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return W.distinct(*W.shingles(W.find_words(column, W.SPACED), n))


def _set_sums(first: np.ndarray, values: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(seed)))])
    return sums[first[1:]] - sums[first[:-1]]


def described(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, bands): a and b tell sets apart as 128 bits."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at, end in W.slices(column, 1 << 18):
                first, values = shingle_sets(column.slice(at, end - at), n)
                keys = band_keys(superminhash(first, values, bands * rows), bands).view(np.int64)
                full = np.diff(first) > 0
                ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at),
                        pa.array(np.diff(first)),
                        pa.array(_set_sums(first, values, 0x5851F42D4C957F2D).view(np.int64)),
                        pa.array(_set_sums(first, values, 0x14057B7EF767814F).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "a", "b", "bands"],
                )

    return docs.mapInArrow(describe, "doc_id long, n_shingles long, a long, b long, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by their whole texts."""
    both = with_texts(pairs, docs.select("doc_id", "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            sizes = W.byte_sizes(left) + W.byte_sizes(right)
            parts = np.cumsum(sizes) // (1 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(sizes)]
            keep = []
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                fa, va = shingle_sets(left.slice(at, end - at), n)
                fb, vb = shingle_sets(right.slice(at, end - at), n)
                for i in range(end - at):
                    both = np.concatenate([va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]]])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), mask) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def likely(texts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``texts`` whose id leaves the same rest as one of ``ids``: most others need not be shuffled.

    There are at most ``RESTS`` rests, so they may be broadcast.
    """
    rest = F.pmod(F.xxhash64(key), F.lit(RESTS)).cast("int").alias("_rest")
    rests = F.broadcast(ids.select(rest).distinct())
    own = F.pmod(F.xxhash64("doc_id"), F.lit(RESTS)).cast("int")
    return texts.join(rests, own == rests["_rest"], "left_semi")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with text_a and text_b. A ``b`` in very many pairs is repeated for shares of them.

    The shares are settled before texts are added, so a text is shuffled no more than twice.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_shares"))
    share = F.pmod(F.xxhash64("a"), F.col("_shares").cast("long")).cast("int")
    dealt = pairs.join(shares, "b").select("a", "b", share.alias("_share"))
    left = likely(texts, pairs, "a").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = likely(texts, pairs, "b").join(shares, F.col("doc_id") == F.col("b"))
    right = right.select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    return dealt.join(left, "a").join(right, ["b", "_share"]).select("a", "b", "text_a", "text_b")


class _Grouping:
    """Links found so far and the groups that they make."""

    def __init__(self, scratch: Scratch, docs: DataFrame, n: int, percent: int):
        self.scratch, self.docs, self.n, self.percent = scratch, docs, n, percent
        self.links: DataFrame | None = None
        self.groups: DataFrame | None = None

    def confirm(self, pairs: Stored) -> None:
        if not pairs.rows:
            return
        found = confirmed(pairs.df, self.docs, self.n, self.percent)
        found = self.scratch.save(found, self.scratch.place("confirmed"))
        if not found.rows:
            return
        self.links = found.df if self.groups is None else found.df.unionByName(
            self.groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        )
        self.groups = components(self.scratch, self.links)

    def of(self, rows: DataFrame, column: str) -> DataFrame:
        """Add ``component`` of the id in ``column``."""
        if self.groups is None:
            return rows.withColumn("component", F.col(column))
        known = self.groups.select(F.col("id").alias(column), F.col("component").alias("_found"))
        return rows.join(known, column, "left").withColumn("component", F.coalesce("_found", column)).drop("_found")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    n: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach; two documents are linked if their sets
    of distinct ``n``-word shingles have a Jaccard similarity of ``percent`` or more. Words are split at ASCII
    white space, A-Z lowered. Null and empty texts have no shingles and are linked with nothing, nor are
    rows without a doc_id, whose component is null. Repeated rows stay. Only doc_id and text are read.
    """
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.save(described(docs, n, bands, band_rows), scratch.place("described")).df
    key = ["n_shingles", "a", "b"]
    linked = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = linked.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, scratch.place("classes")).df

    keyed = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("_last"))
    shared = shared.filter(F.col("centre") < F.col("_last")).drop("_last")
    met = scratch.save(keyed.join(shared, "bucket"), scratch.place("buckets"))
    grouping = _Grouping(scratch, docs, n, percent)
    if met.rows:
        nearest = met.df.filter(F.col("id") > F.col("centre")).groupBy("id").agg(F.min("centre").alias("b"))
        grouping.confirm(scratch.save(nearest.select(F.col("id").alias("a"), "b"), scratch.place("pairs")))
        _meet_in_buckets(scratch, grouping, met, percent)

    final = grouping.of(classes.select(*key, "id"), "id").drop("id")
    placed = linked.select("doc_id", *key).join(final, key).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return placed.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _mixed(scratch: Scratch, placed: DataFrame, centre: Column) -> Stored:
    """The rows (bucket, id, n_shingles, component, ...) of buckets with several groups, with a member ``c`` of the bucket."""
    found = placed.groupBy("bucket").agg(
        F.min_by(F.struct("id", "n_shingles", "component"), centre).alias("c"),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
    )
    found = found.filter(F.col("_low") < F.col("_high")).select("bucket", "c")
    return scratch.save(placed.join(found, "bucket"), scratch.place("mixed"))


def _meet_in_buckets(scratch: Scratch, grouping: _Grouping, met: Stored, percent: int) -> None:
    """Compare what shares a bucket and is not yet in one group: stars first, then all that can still be linked."""
    rows = met.df
    for turn in range(STAR_ROUNDS):
        # One member of each bucket in turn: the smallest, then others by a hash.
        centre = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        left = _mixed(scratch, grouping.of(rows.select("bucket", "id", "n_shingles"), "id"), centre)
        if not left.rows:
            return
        rows = left.df
        met_by = rows.select(
            "id", "n_shingles", "component",
            F.col("c.id").alias("other"), F.col("c.n_shingles").alias("_n"), F.col("c.component").alias("_component"),
        )
        fits = F.least("n_shingles", "_n") * 100 >= F.greatest("n_shingles", "_n") * percent
        pairs = met_by.filter((F.col("component") != F.col("_component")) & fits)
        pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
        grouping.confirm(scratch.save(pairs, scratch.place("pairs")))
    left = _mixed(scratch, grouping.of(rows.select("bucket", "id", "n_shingles"), "id"), F.col("id"))
    if not left.rows:
        return
    members = scratch.save(left.df.select("id", "n_shingles", "component").distinct(), scratch.place("open")).df
    rare = _rare_shingles(scratch, grouping, left.df)
    own = rare.groupBy("id").agg(F.count(F.lit(1)).alias("_rare"))
    common = F.col("n_shingles") - F.coalesce("_rare", F.lit(0))
    members = members.join(own, "id", "left").withColumn("common", common).drop("_rare")
    members = scratch.save(members, scratch.place("bounded")).df
    pairs = _sharing_rare(rare, members, percent).unionByName(_sharing_common(scratch, left.df, members, percent))
    grouping.confirm(scratch.save(pairs.distinct(), scratch.place("pairs")))


def _rare_shingles(scratch: Scratch, grouping: _Grouping, rows: DataFrame) -> DataFrame:
    """(id, cluster, shingle) of shingles that few documents of a cluster have; a cluster is what buckets connect."""
    n = grouping.n
    met = rows.select(F.col("id").alias("a"), F.col("c.id").alias("b"))
    clusters = components(scratch, met.filter("a <> b").distinct())
    ids = rows.select("id").distinct().join(clusters, "id", "left")
    ids = ids.select("id", F.coalesce("component", "id").alias("cluster"))
    docs = likely(grouping.docs, ids, "id")
    texts = docs.join(ids, docs["doc_id"] == ids["id"]).select("id", "cluster", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in W.slices(batch.column(2)):
                first, values = shingle_sets(batch.column(2).slice(at, end - at), n)
                owner = pa.array(at + np.repeat(np.arange(end - at), np.diff(first)))
                made = [batch.column(c).take(owner) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(values.view(np.int64))], ["id", "cluster", "shingle"])

    spread_out = texts.dropDuplicates(["id"]).mapInArrow(spread, "id long, cluster long, shingle long")
    shingles = scratch.save(spread_out, scratch.place("shingles")).df
    few = shingles.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= RARE).drop("_n")
    return scratch.save(shingles.join(few, ["cluster", "shingle"]), scratch.place("rare")).df


def _possible(shared: Column, percent: int) -> Column:
    """Whether two sets that share so many shingles at most can be linked."""
    return shared * 100 >= (F.col("n_shingles") + F.col("_n") - shared) * percent


def _beside(members: DataFrame) -> DataFrame:
    return members.select(
        F.col("id").alias("other"), F.col("n_shingles").alias("_n"), F.col("common").alias("_common"),
        F.col("component").alias("_component"),
    )


def _sharing_rare(rare: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of documents that share rare shingles, as far as their number and the common ones allow a link.

    A rare shingle has at most ``RARE`` documents, so it makes a bounded number of pairs.
    """
    one = rare.join(members.select("id", "component"), "id")
    other = one.select("cluster", "shingle", F.col("id").alias("other"), F.col("component").alias("_component"))
    apart = (F.col("id") < F.col("other")) & (F.col("component") != F.col("_component"))
    met = one.join(other, ["cluster", "shingle"]).filter(apart).groupBy("id", "other").agg(F.count(F.lit(1)).alias("_shared"))
    both = met.join(members, "id").join(_beside(members), "other")
    both = both.filter(_possible(F.least("common", "_common") + F.col("_shared"), percent))
    return both.select(F.col("other").alias("a"), F.col("id").alias("b"))


def _sharing_common(scratch: Scratch, rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of documents in one bucket that can be linked without sharing any rare shingle."""
    rows = rows.select("bucket", "id").join(members, "id")
    smallest = rows.groupBy("bucket").agg(F.min("n_shingles").alias("_least"))
    # What cannot be linked even to the smallest document that is large enough for a link goes first.
    partner = F.ceil(F.greatest(F.col("_least") * 100, F.col("n_shingles") * percent) / 100).alias("_n")
    kept = rows.join(smallest, "bucket").withColumn("_n", partner).filter(_possible(F.col("common"), percent)).drop("_least", "_n")
    left = _mixed(scratch, kept, F.col("id")).df
    # A large bucket is dealt in shares, each of which meets all its members.
    shares = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_SHARE).cast("int").alias("_shares"))
    dealt = left.join(shares, "bucket").withColumn("_share", F.pmod(F.xxhash64("id"), F.col("_shares").cast("long")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    cells = ["bucket", F.col("id").alias("other"), F.col("n_shingles").alias("_n"), F.col("common").alias("_common")]
    beside = left.join(shares, "bucket").select(*cells, F.col("component").alias("_component"), every)
    apart = (F.col("id") < F.col("other")) & (F.col("component") != F.col("_component"))
    met = dealt.join(beside, ["bucket", "_share"]).filter(apart & _possible(F.least("common", "_common"), percent))
    return met.select(F.col("other").alias("a"), F.col("id").alias("b"))
