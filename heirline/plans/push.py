"""Sweeps that push values along the edges, layer by layer.

The finished rows of a layer are joined to the edges that leave it, merged per target, and written by the layer of the
target. So every edge and every row is read once, however deep the graph is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.plans.adjacency import repeat_hot
from heirline.plans.scratch import Stored
from heirline.plans.sweep import gathered

MOST_ROUNDS = 64


@dataclass(frozen=True)
class Pushed:
    """(near, far, far_layer[, salt]) stored by ``at``, the layer of the near end. ``targets`` lists the far layers of each."""

    edges: Stored
    targets: dict[int, list[int]]


def pushed_edges(graph, direction: str) -> Pushed:
    """The edges by the layer from which values are pushed on."""
    near, far, hot = ("src", "dst", graph.hot_sources) if direction == "forward" else ("dst", "src", graph.hot_targets)
    # Slices hold the layer of the target already.
    layers = graph.layers.select(F.col("node_id").alias("src"), F.col("layer").alias("_src_layer"))
    rows = graph.slices.df.join(layers, "src")
    at, to = ("_src_layer", "layer") if direction == "forward" else ("layer", "_src_layer")
    salt = [F.col(f"{near}_salt").alias("salt")] if hot is not None else []
    ends = rows.select(F.col(near).alias("near"), F.col(far).alias("far"), *salt, F.col(to).cast("int").alias("far_layer"), F.col(at).alias("at"))
    stored = graph.scratch.save(gathered(ends, "at", graph.rounds), graph.scratch.place(f"pushed-{direction}"), partition_by=("at",))
    targets: dict[int, list[int]] = {}
    for r in stored.df.select("at", "far_layer").distinct().collect():
        targets.setdefault(r["at"], []).append(r.far_layer)
    return Pushed(stored, targets)


def can_push(graph) -> bool:
    """Sweeps take a round per layer, so deep graphs are walked."""
    return graph.tail is None and graph.rounds <= MOST_ROUNDS


def push(graph, direction: str, own: DataFrame, keys: list[str], merged: dict[str, Column]) -> DataFrame:
    """(node_id, keys, values): what reaches a vertex over one edge or more, merged per vertex and keys.

    ``own`` (node_id, layer, keys, values) is what vertices start with. A vertex hands on its own values merged with those
    that reached it. ``merged`` tells how each value is merged; the order must not matter.
    """
    scratch = graph.scratch
    pushed = graph.pushed_forward if direction == "forward" else graph.pushed_backward
    hot = graph.hot_sources if direction == "forward" else graph.hot_targets
    columns = ["node_id", *keys, *merged]
    row = T.StructType([own.schema[c] for c in columns])
    # Read back, all columns may be null.
    row = T.StructType([T.StructField(f.name, f.dataType) for f in row])
    begun = scratch.save(own.select(*columns, F.col("layer").alias("at")), scratch.place("own"), partition_by=("at",), figures={"low": F.min("at"), "high": F.max("at")})
    begin = T.StructType([*row, T.StructField("at", T.IntegerType())])
    whole = T.StructType([*row, T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
    edge = T.StructType([f for f in pushed.edges.df.schema.fields if f.name != "at"])
    base = scratch.place(f"push-{direction}")
    merging = [m.alias(n) for n, m in merged.items()]
    sent: dict[int, list[str]] = {}
    done, alone = False, []
    order = range(graph.rounds) if direction == "forward" else range(graph.rounds - 1, -1, -1)
    for layer in order if begun.rows else ():
        mine = scratch.read(begun.path, begin).filter(F.col("at") == layer).drop("at")
        begins = begun.figures["low"] <= layer <= begun.figures["high"]
        if layer in sent:
            if len(sent[layer]) == 1:
                # What comes from one layer is merged already.
                arrived = scratch.read(f"{base}/{sent[layer][0]}", row)
                alone += sent[layer]
            else:
                arrived = scratch.read(base, whole, *sent[layer]).groupBy("node_id", *keys).agg(*merging)
                arrived = scratch.save(arrived, f"{base}-done/layer={layer}").df
                done = True
            mine = arrived.unionByName(mine).groupBy("node_id", *keys).agg(*merging) if begins else arrived
        elif not begins:
            continue
        if layer not in pushed.targets:
            continue
        out = scratch.read(f"{pushed.edges.path}/at={layer}", edge)
        held = repeat_hot(mine, hot, "node_id", "_salt")
        on = held["node_id"] == out["near"]
        if hot is not None:
            on = on & (held["_salt"] == out["salt"])
        met = held.join(out, on).groupBy(F.col("far").alias("node_id"), *keys, F.col("far_layer").alias("to")).agg(*merging)
        counts = {f"to_{to}": F.count_if(F.col("to") == to) for to in pushed.targets[layer]}
        saved = scratch.save(gathered(met.select(*columns, "to"), "to", len(counts)), f"{base}/from={layer}", partition_by=("to",), figures=counts)
        for to in pushed.targets[layer]:
            if saved.figures[f"to_{to}"]:
                sent.setdefault(to, []).append(f"from={layer}/to={to}")
    finished = [scratch.read(base, whole, *alone).drop("from", "to")] if alone else []
    if done:
        finished.append(scratch.read(f"{base}-done", T.StructType([*row, T.StructField("layer", T.IntegerType())])).drop("layer"))
    return reduce(DataFrame.unionByName, finished) if finished else graph.spark.createDataFrame([], row)
