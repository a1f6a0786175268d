"""Reachability, closures and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.plans.bitmaps import BITS, WORD_NAMES, closure, is_set
from heirline.plans.frontier import walk
from heirline.plans.push import can_push


def starts(ids: DataFrame) -> DataFrame:
    """(query_id, node_id) for walks that begin at the ids themselves."""
    return ids.select(F.col("node_id").alias("query_id"), "node_id").distinct()


def reached(graph, ids: DataFrame, direction: str, max_hops: int | None = None) -> DataFrame:
    """(query_id, node_id, hops) within ``max_hops`` of every id, the id itself left out."""
    return walk(graph, starts(ids), direction, max_hops).filter("hops > 0")


# From so many ids on, closures are swept as bitmaps instead of walked.
MANY_IDS = 64


def many(graph, ids: DataFrame) -> bool:
    """Whether closures of the ids are swept."""
    return can_push(graph) and len(ids.select("node_id").distinct().take(MANY_IDS)) == MANY_IDS


def closed(graph, ids: DataFrame, direction: str) -> DataFrame:
    """(query_id, node_id) of everything reached from every id, the id itself left out, without hops."""
    if many(graph, ids):
        return closure(graph, ids, direction).pairs()
    return reached(graph, ids, direction).drop("hops")


def descendants(graph, ids: DataFrame) -> DataFrame:
    """(query_id, node_id) of everything downstream."""
    return closed(graph, ids, "forward")


def ancestors(graph, ids: DataFrame) -> DataFrame:
    """(query_id, node_id) of everything upstream."""
    return closed(graph, ids, "backward")


def hop_counts(graph, ids: DataFrame, max_hops: int) -> DataFrame:
    """(query_id, k, impacted): how many vertices lie within 1, 2, ... ``max_hops``."""
    rows = reached(graph, ids, "forward", max_hops)
    sizes = rows.groupBy("query_id").agg(
        *[F.count_if(F.col("hops") <= k).alias(f"within_{k}") for k in range(1, max_hops + 1)]
    )
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"within_{k}").alias("n")) for k in range(1, max_hops + 1)])
    filled = starts(ids).select("query_id").join(sizes, "query_id", "left").na.fill(0)
    return filled.select("query_id", F.explode(steps).alias("s")).select(
        "query_id", F.col("s.k").alias("k"), F.col("s.n").alias("impacted")
    )


def swept_pairs(graph, pairs: DataFrame) -> DataFrame:
    """(src, dst, hit) per distinct pair (src, dst), from one sweep of bitmaps that begins at the side with fewer ids.

    For graphs that :func:`heirline.plans.push.can_push`.
    """
    ends = pairs.agg(F.approx_count_distinct("src").alias("src"), F.approx_count_distinct("dst").alias("dst")).first()
    near, far, direction = ("src", "dst", "forward") if ends.src <= ends.dst else ("dst", "src", "backward")
    made = closure(graph, pairs.select(F.col(near).alias("node_id")), direction)
    numbered = pairs.join(made.starts.withColumnRenamed("query_id", near), near)
    reached = made.reached.select(F.col("node_id").alias(far), "block", F.array(*WORD_NAMES).alias("_words"))
    numbered = numbered.withColumn("block", F.floor(F.col("number") / BITS))
    met = numbered.join(reached, [far, "block"], "left")
    return met.select("src", "dst", is_set("_words").alias("hit"))


def can_reach(graph, pairs: DataFrame, reflexive: bool = True) -> DataFrame:
    """(src, dst, reachable) per distinct pair; an unknown id reaches nothing.

    Every edge leads to a higher layer. So a target that is not below its source needs
    no look. From ``MANY_IDS`` open pairs on, they are swept; fewer are walked, and a source stops after
    as many hops as its deepest target is layers away.
    """
    asked = pairs.select("src", "dst").distinct()
    low = graph.layers.select(F.col("node_id").alias("src"), F.col("layer").alias("_from"))
    high = graph.layers.select(F.col("node_id").alias("dst"), F.col("layer").alias("_to"))
    placed = asked.join(low, "src", "left").join(high, "dst", "left")
    stored = graph.scratch.save(
        placed.withColumn("_gap", F.col("_to") - F.col("_from")),
        graph.scratch.place("pairs"),
        figures={"open": F.count_if(F.col("_gap") > 0)},
    )
    known = stored.df
    open_pairs = known.filter(F.col("_gap") > 0)
    if stored.figures["open"] >= MANY_IDS and can_push(graph):
        hits = swept_pairs(graph, open_pairs.select("src", "dst")).filter("hit").withColumnRenamed("hit", "_hit")
    else:
        begin = open_pairs.groupBy(F.col("src").alias("query_id")).agg(F.max("_gap").alias("budget"))
        seen = walk(graph, begin.withColumn("node_id", F.col("query_id")), "forward")
        hits = seen.select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"), F.lit(True).alias("_hit"))
    same = (F.col("src") == F.col("dst")) & F.col("_gap").isNotNull()
    found = (F.col("_gap") > 0) & F.col("_hit").isNotNull()
    answer = F.when(same, F.lit(reflexive)).otherwise(F.coalesce(found, F.lit(False)))
    return known.join(hits, ["src", "dst"], "left").select("src", "dst", answer.alias("reachable"))
