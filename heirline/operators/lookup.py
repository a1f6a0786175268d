"""Look-ups by id, for one or many ids at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.schema import DEFAULT_WEIGHT


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The artifacts with the requested ids."""
    return nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def exists(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, known) per requested id."""
    have = nodes.select("node_id", F.lit(True).alias("known"))
    return ids.select("node_id").distinct().join(have, "node_id", "left").na.fill(False, ["known"])


def children(graph, ids: DataFrame) -> DataFrame:
    """(node_id, child, weight)."""
    met = graph.forward.meet(ids.select("node_id").distinct())
    return met.select(F.col("near").alias("node_id"), F.col("far").alias("child"), "weight")


def parents(graph, ids: DataFrame) -> DataFrame:
    """(node_id, parent, weight)."""
    met = graph.backward.meet(ids.select("node_id").distinct())
    return met.select(F.col("near").alias("node_id"), F.col("far").alias("parent"), "weight")


def edge_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) per pair; the default weight where there is no edge."""
    known = edges.select("src", "dst", "weight")
    return pairs.select("src", "dst").join(known, ["src", "dst"], "left").na.fill(DEFAULT_WEIGHT, ["weight"])
