"""Synthetic DAG for load tests: a chain of all vertices plus short forward edges.

Everything is integer arithmetic over the vertex number, so rows do not depend on
the partitioning and any SQL engine can produce the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirline.plans.prefix import running_total
from heirline.plans.scratch import Scratch

# Types by vertex number, creators, reach and most extra edges.
TYPE_CYCLE = ("dataset", "tool", "model", "model", "model", "product")
CREATORS = 20
VERSIONS = 10
REACH = 10
MAX_EXTRA = 5000
DRAWS = 1_000_003


def _name(number: Column) -> Column:
    return F.concat(F.lit("node_"), number.cast("string"))


def synthetic_dag(ids: DataFrame, size: int, max_extra: int = MAX_EXTRA) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over vertex numbers ``i`` from 0 to ``size - 1``.

    ``ids`` is any DataFrame with that column, such as ``spark.range(n).toDF("i")``.
    The chain has weights in [0.5, 1); ``min(2 * size, max_extra)`` further edges lead 2
    to 10 ahead, with weights in [0.3, 0.9): those first in the order of a draw, which is
    counted over ranges, not gathered in one task.
    """
    i = F.col("i")
    kinds = F.array(*[F.lit(t) for t in TYPE_CYCLE])
    nodes = ids.select(
        _name(i).alias("node_id"),
        F.element_at(kinds, (i % len(TYPE_CYCLE)).cast("int") + 1).alias("node_type"),
        F.create_map(
            F.lit("name"), F.concat(F.lit("Artifact-"), i.cast("string")),
            F.lit("version"), (i % VERSIONS).cast("string"),
        ).alias("content"),
        F.concat(F.lit("org_"), (i % CREATORS).cast("string")).alias("creator"),
    )
    chain = ids.filter(i < size - 1).select(
        _name(i).alias("src"), _name(i + 1).alias("dst"), (F.lit(0.5) + (i * 37 % 1000) / 2000.0).alias("weight")
    )
    step = F.col("step")
    possible = (
        ids.select("i", F.explode(F.sequence(F.lit(2), F.lit(REACH))).alias("step"))
        .filter(i + step < size)
        .withColumn("draw", (i * 7919 + step * 104729) % DRAWS)
    )
    scratch = Scratch(ids.sparkSession)
    placed = running_total(scratch, possible, ["draw", "i", "step"], F.lit(1), "place")
    extra = (
        placed.filter(F.col("place") < min(2 * size, max_extra))
        .select(
            _name(i).alias("src"),
            _name(i + step).alias("dst"),
            (F.lit(0.3) + ((i * 53 + step * 29) % 600) / 1000.0).alias("weight"),
        )
    )
    return nodes, chain.unionByName(extra)
