"""Deep parts of a graph that would need one round per layer.

After a number of layers, what is left often falls into many small pieces, such as
long version chains. Pieces below a row limit are done whole, each in one group of
``applyInPandas``, all of them in one job. Larger pieces stay with the layer rounds; their layers are
found by clusters (:mod:`heirline.plans.deep`).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.plans.scratch import Scratch, Stored

DEEP_AFTER = 32
PIECE_ROWS = 200_000


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node_id, component) of the vertices of (src, dst), read as undirected edges.

    Alternates large-star and small-star steps, each a minimum per vertex joined back
    to its edges, until nothing changes; the count of rounds grows with the logarithm
    of the longest chain.
    """

    def linked(pairs: DataFrame, both: bool) -> DataFrame:
        """Join every vertex to the least vertex around it."""
        sides = pairs.unionByName(pairs.select(F.col("low").alias("high"), F.col("high").alias("low"))) if both else pairs
        least = sides.groupBy("high").agg(F.min("low").alias("_near"))
        near = least.select(F.col("high").alias("_at"), F.least("_near", "high").alias("_least"))
        met = sides.join(near, sides["high"] == near["_at"])
        if both:
            return met.filter("low > high").select(F.col("low").alias("high"), F.col("_least").alias("low"))
        moved = met.select(F.col("low").alias("high"), F.col("_least").alias("low"))
        return moved.unionByName(near.select(F.col("_at").alias("high"), F.col("_least").alias("low")))

    pairs = edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct()
    mark = {"mark": F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))}
    stored = scratch.save(pairs, scratch.place("stars"), figures=mark)
    while True:
        before = stored.figures
        large = linked(stored.df, both=True).distinct()
        small = linked(large, both=False).filter("high <> low").distinct()
        stored = scratch.save(small, scratch.place("stars"), figures=mark)
        if stored.figures == before:
            break
    roots = stored.df.select(F.col("low").alias("node_id"), F.col("low").alias("component"))
    leaves = stored.df.select(F.col("high").alias("node_id"), F.col("low").alias("component"))
    return leaves.unionByName(roots).distinct()


def _ordered(edges: pd.DataFrame, first: int) -> dict[str, int]:
    """Layer per vertex from the edges of one piece; vertices on or below a cycle lack."""
    children, missing = defaultdict(list), defaultdict(int)
    for src, dst in zip(edges["src"], edges["dst"], strict=True):
        children[src].append(dst)
        missing[dst] += 1
    layer, found = first, {}
    level = [n for n in children if not missing[n]]
    while level:
        found.update(dict.fromkeys(level, layer))
        following = []
        for node in level:
            for child in children[node]:
                missing[child] -= 1
                if not missing[child]:
                    following.append(child)
        level, layer = following, layer + 1
    return found


def take_tail(graph, waiting: DataFrame, first: int) -> Stored | None:
    """(node_id, component, layer) of waiting vertices in small pieces; None without any.

    ``first`` is the layer of a waiting vertex that waits for no other waiting one.
    ``layer`` is null where a cycle prevents an order.
    """
    scratch = graph.scratch
    inner = scratch.save(
        graph.forward.meet(waiting.select("node_id")).select(F.col("near").alias("src"), F.col("far").alias("dst")),
        scratch.place("tail-edges"),
    )
    if not inner.rows:
        return None
    members = scratch.save(components(scratch, inner.df), scratch.place("pieces")).df
    placed = inner.df.join(members.withColumnRenamed("node_id", "src"), "src")
    small = placed.groupBy("component").count().filter(F.col("count") <= graph.piece_rows).select("component")
    rows = placed.join(small, "component", "left_semi")

    def order(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        found = _ordered(edges, first)
        names = sorted(set(edges["src"]) | set(edges["dst"]))
        layers = pd.array([found.get(n) for n in names], dtype="Int32")
        return pd.DataFrame({"node_id": names, "component": key[0], "layer": layers})

    done = rows.groupBy("component").applyInPandas(order, "node_id string, component string, layer int")
    stored = scratch.save(
        done, scratch.place("tail"), figures={"stuck": F.count_if(F.col("layer").isNull()), "top": F.max("layer")}
    )
    return stored if stored.rows else None


def tail_pass(
    graph,
    own: DataFrame,
    edges: DataFrame,
    above: DataFrame,
    carry: Callable,
    fold: Callable,
    kind: str,
) -> DataFrame:
    """(node_id, value) of the vertices in small pieces, parents first.

    ``own`` (node_id, own) is what a vertex brings itself, ``edges`` (src, dst, weight)
    lead into the pieces, ``above`` (node_id, value) is what finished parents outside
    hand down. A parent inside hands down ``carry(value, weight)``; a vertex becomes
    ``fold(own, handed down)``. ``kind`` is the SQL type of values.
    """
    tail = graph.tail.df
    place = tail.select("node_id", "component", "layer")
    inside = tail.select(F.col("node_id").alias("src"))
    inner = edges.join(inside, "src", "left_semi").withColumnRenamed("dst", "node_id")
    none = F.lit(None)

    def rows(df: DataFrame, src, weight, own_value, value) -> DataFrame:
        return df.select(
            "node_id", "component", "layer", src.cast("string").alias("src"), weight.cast("double").alias("weight"),
            own_value.cast(kind).alias("own"), value.cast(kind).alias("value"),
        )

    gathered = (
        rows(place.join(own, "node_id", "left"), none, none, F.col("own"), none)
        .unionByName(rows(inner.join(place, "node_id"), F.col("src"), F.col("weight"), none, none))
        .unionByName(rows(above.join(place, "node_id"), none, none, none, F.col("value")))
    )

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        linked = piece[piece["src"].notna()]
        handed, parents = defaultdict(list), defaultdict(list)
        for node, src, weight in zip(linked["node_id"], linked["src"], linked["weight"], strict=True):
            parents[node].append((src, weight))
        outside = piece[piece["value"].notna()]
        for node, value in zip(outside["node_id"], outside["value"], strict=True):
            handed[node].append(value)
        vertices = piece[piece["src"].isna() & piece["value"].isna()].sort_values(["layer", "node_id"])
        values: dict = {}
        for node, own_value in zip(vertices["node_id"], vertices["own"], strict=True):
            below = handed[node] + [carry(values[p], w) for p, w in parents[node]]
            values[node] = fold(own_value, below)
        return pd.DataFrame({"node_id": list(values), "value": list(values.values())})

    return gathered.groupBy("component").applyInPandas(run, f"node_id string, value {kind}")
