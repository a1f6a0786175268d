"""Layer-by-layer jobs: every layer is computed from the finished ones above it.

Edges are stored by the layer of their target, so all rounds of a sweep together
read each edge once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.plans.adjacency import Adjacency, repeat_hot
from heirline.plans.scratch import Stored


# Rows of at most so many layers are written by layer where they are; a task then writes a file for each.
FEW_LAYERS = 8


def gathered(rows: DataFrame, layer: str, layers: int) -> DataFrame:
    """Rows to be written by ``layer``.

    With many ``layers`` a rebalance keeps the number of files down and splits a large layer; with few, it would only shuffle all rows once more.
    """
    return rows if layers <= FEW_LAYERS else rows.hint("rebalance", layer)


def edge_slices(graph) -> Stored:
    """(src, dst, weight[, salts]) partitioned by ``layer``, that of ``dst``, -1 in the tail."""
    edges = graph.by_target
    placed = edges.meet(graph.round_of)
    salts = [
        F.col(c).alias(n)
        for c, n in (("near_salt", "dst_salt"), ("far_salt", "src_salt"))
        if c in edges.table.columns
    ]
    rows = placed.select(F.col("far").alias("src"), F.col("near").alias("dst"), "weight", *salts, "layer")
    return graph.scratch.save(gathered(rows, "layer", graph.rounds), graph.scratch.place("slices"), partition_by=("layer",))


def slice_of(graph, layer: int) -> DataFrame:
    """Edges into ``layer``."""
    schema = T.StructType([f for f in graph.slices.df.schema.fields if f.name != "layer"])
    return graph.scratch.read(f"{graph.slices.path}/layer={layer}", schema)


def edges_into(graph, layer: int) -> Adjacency:
    """The edges into ``layer`` by target."""
    names = {"dst": "near", "src": "far", "dst_salt": "near_salt", "src_salt": "far_salt"}
    return Adjacency(slice_of(graph, layer).withColumnsRenamed(names), graph.hot_targets)


def with_parent_values(graph, edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges joined to the finished value of their source; hot sources are split."""
    known = repeat_hot(values, graph.hot_sources, "node_id", "_salt")
    on = edges["src"] == known["node_id"]
    if graph.hot_sources is not None:
        on = on & (edges["src_salt"] == known["_salt"])
    return edges.join(known, on).drop("node_id", "_salt")


def sweep(
    graph,
    name: str,
    first: DataFrame,
    step: Callable[[int, DataFrame, DataFrame], DataFrame],
    last: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Run ``step(layer, edges into the layer, finished rows)`` from layer 1 on.

    ``first`` holds the rows of layer 0. Each layer's rows are written before the next
    begins. A tail, if there is one, follows as ``last(edges into it, finished rows)``.
    """
    base = graph.scratch.place(name)
    schema = graph.scratch.save(first, f"{base}/layer=0").df.schema
    whole = T.StructType([*schema.fields, T.StructField("layer", T.IntegerType())])

    def finished() -> DataFrame:
        return graph.scratch.read(base, whole).drop("layer")

    for layer in range(1, graph.rounds):
        graph.scratch.save(step(layer, slice_of(graph, layer), finished()), f"{base}/layer={layer}")
    if graph.tail is not None:
        graph.scratch.save(last(slice_of(graph, -1), finished()), f"{base}/layer=-1")
    return finished()
