"""Topological layers, order and cycle detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.plans.deep import take_deep
from heirline.plans.prefix import running_total
from heirline.plans.scratch import Stored
from heirline.plans.tail import take_tail
from heirline.sources.ingest import InvalidCatalog

LAYERS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("missing", T.LongType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("ready", T.BooleanType()),
    ]
)


class Peeled:
    """What :func:`peel` found."""

    def __init__(self, layers: DataFrame, stuck: DataFrame | None, depth: int, tail: Stored | None):
        self.layers = layers
        self.stuck = stuck
        self.depth = depth
        self.tail = tail


def peel(graph) -> Peeled:
    """Take off one layer of vertices after the other.

    Every round joins the newest layer to its out-edges and subtracts the counts from
    the number of parents still missing; a vertex that reaches zero is the next layer.
    The edges are bucketed by source and never shuffled. After ``graph.deep_after``
    layers, small pieces of what is left are ordered in one go as the tail, and after twice as
    many, larger ones in clusters.
    """
    scratch = graph.scratch
    base = scratch.place("layers")
    frontier = graph.roots
    waiting = graph.degrees.df.filter("in_degree > 0").select("node_id", F.col("in_degree").alias("missing"))
    scratch.save(
        frontier.select("node_id", F.lit(0).cast("long").alias("missing"), F.lit(True).alias("ready")),
        f"{base}/layer=0",
        partition_by=("ready",),
    )
    layer, ready = 0, graph.degrees.figures["roots"]
    open_rows = graph.degrees.rows - ready
    done, tail, deep = [], None, None
    while ready:
        done.append(f"layer={layer}/ready=true")
        if open_rows and layer == graph.deep_after:
            tail = take_tail(graph, waiting, layer + 1)
            if tail is not None:
                open_rows -= tail.rows
                waiting = waiting.join(tail.df.select("node_id"), "node_id", "left_anti")
        if open_rows and layer == 2 * graph.deep_after:
            deep = take_deep(graph, waiting, layer + 1)
            if deep is not None:
                open_rows -= deep.rows
                waiting = waiting.join(deep.df.select("node_id"), "node_id", "left_anti")
        if not open_rows:
            break
        layer += 1
        met = graph.forward.meet(frontier).groupBy(F.col("far").alias("node_id"))
        hits = met.agg((-F.count(F.lit(1))).alias("missing"))
        sums = waiting.unionByName(hits).groupBy("node_id")
        left = sums.agg(F.sum("missing").alias("missing"), F.max("missing").alias("_was")).filter("_was > 0")
        stored = scratch.save(
            left.select("node_id", "missing", (F.col("missing") == 0).alias("ready")),
            f"{base}/layer={layer}",
            partition_by=("ready",),
            figures={"ready": F.count_if("ready"), "open": F.count_if(~F.col("ready"))},
        )
        ready, open_rows = stored.figures["ready"], stored.figures["open"]
        if ready:
            frontier = scratch.read(base, LAYERS, f"layer={layer}/ready=true").select("node_id")
        if open_rows:
            waiting = scratch.read(base, LAYERS, f"layer={layer}/ready=false").select("node_id", "missing")
    if done:
        layers = scratch.read(base, LAYERS, *done).select("node_id", "layer")
    else:
        layers = graph.spark.createDataFrame([], "node_id string, layer int")
    depth = len(done)
    if deep is not None:
        layers = layers.unionByName(deep.df.filter(F.col("layer").isNotNull()))
        depth = max(depth, (deep.figures["top"] or 0) + 1)
    stuck = waiting.select("node_id") if open_rows else None
    for part in (tail, deep):
        if part is not None and part.figures["stuck"]:
            lost = part.df.filter(F.col("layer").isNull()).select("node_id")
            stuck = lost if stuck is None else stuck.unionByName(lost)
    return Peeled(layers, stuck, depth, tail)


def require_acyclic(graph) -> Peeled:
    """The layers, or an error with the counts and a few vertices that stay."""
    peeled = peel(graph)
    if peeled.stuck is not None:
        names = [r.node_id for r in peeled.stuck.orderBy("node_id").take(5)]
        total, kept = graph.node_count, peeled.stuck.count()
        raise InvalidCatalog(f"cycle: {total - kept} of {total} vertices ordered; among the rest: {', '.join(names)}")
    return peeled


def cycle_nodes(graph) -> DataFrame:
    """Vertices that cannot be ordered: on a cycle or below one. Empty for a DAG."""
    stuck = peel(graph).stuck
    return stuck if stuck is not None else graph.nodes.select("node_id").limit(0)


def topological_order(graph) -> DataFrame:
    """(node_id, layer, position): every parent comes before its children."""
    placed = running_total(graph.scratch, graph.layers, ["layer", "node_id"], F.lit(1), "position")
    return placed.orderBy("position")
