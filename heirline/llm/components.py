"""Connected components of a table of links, as rounds over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.plans.scratch import Scratch

# Links that one task may join by union-find, a few megabytes; more are joined in rounds.
LOCAL_LINKS = 100_000


def _join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: a star to the smallest id of each of its groups."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array(members, pa.int64()), pa.array([root(x) for x in members], pa.int64())], ["a", "b"]
    )


def components(scratch: Scratch, links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that it is joined with.

    Each partition first joins its own links by union-find. If at most ``local_links`` remain, one task joins them all;
    else every id is linked to the smallest of its neighbours, towards larger and towards smaller ids in turn,
    until nothing changes. These rounds grow with the logarithm of a group's diameter, not with its size.
    """
    two = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = scratch.save(two.mapInArrow(_join_locally, "a long, b long"), scratch.place("links"), figures=_seen())
    if now.rows <= local_links:
        whole = now.df.coalesce(1).mapInArrow(_join_locally, "a long, b long")
        return scratch.save(whole, scratch.place("links")).df.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while now.rows:
        pairs = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        large = now.df.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
        large = large.select(F.col("v").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = scratch.save(large, scratch.place("links")).df
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(
            met.filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        after = scratch.save(small.distinct(), scratch.place("links"), figures=_seen())
        if after.figures == now.figures:
            break
        now = after
    return now.df.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _seen() -> dict:
    mark = F.xxhash64("a", "b")
    return {"low": F.sum(mark.bitwiseAND(0x7FFFFFFF)), "high": F.sum(F.shiftrightunsigned(mark, 33))}
