"""An index that answers most reachability questions without a walk.

Per artifact it holds its layer, its interval in a spanning forest, the hull of the intervals of all that it reaches, and two
small Bloom sets: of what it reaches, and of what reaches it. An interval inside another is a sure yes. A target in
no higher layer, outside the hull, or with a bit that the source lacks (or the other way round, upward) is a sure no. Only pairs that
none of these decides are swept, all at once as bitmaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.operators.reach import can_reach, swept_pairs
from heirline.plans.push import can_push, push

# 64-bit words of each Bloom set.
SET_WORDS = 4


@dataclass(frozen=True)
class ReachIndex:
    """``labels``: (node_id, layer, disc, fin, low, high, d0.., u0..)."""

    labels: DataFrame


def reach_index(graph, intervals: DataFrame) -> ReachIndex | None:
    """The index over the intervals (node_id, disc, fin) of a spanning forest, by one sweep up and one down.

    None for a graph too deep for sweeps.
    """
    if not can_push(graph):
        return None
    bit = F.pmod(F.xxhash64("node_id"), F.lit(64 * SET_WORDS)).cast("int")
    names = [f"s{i}" for i in range(SET_WORDS)]
    words = [F.when(F.col("_bit").between(64 * i, 64 * i + 63), F.expr("shiftleft(1L, _bit % 64)")).otherwise(F.lit(0).cast("long")).alias(n) for i, n in enumerate(names)]
    own = intervals.join(graph.layers, "node_id").withColumn("_bit", bit)
    own = graph.scratch.save(own.select("node_id", "layer", "disc", "fin", *words), graph.scratch.place("index")).df
    sets = {n: F.bit_or(n) for n in names}
    hull = own.withColumnRenamed("disc", "low").withColumnRenamed("fin", "high")
    below = push(graph, "backward", hull, [], {"low": F.min("low"), "high": F.max("high"), **sets})
    above = push(graph, "forward", own.drop("disc", "fin"), [], sets)

    def merged(side: DataFrame, letter: str) -> DataFrame:
        return side.select("node_id", *[F.col(c).alias(f"_{letter}{c}") for c in side.columns if c != "node_id"])

    joined = own.join(merged(below, "d"), "node_id", "left").join(merged(above, "u"), "node_id", "left")
    sets_of = [F.col(n).bitwiseOR(F.coalesce(f"_{x}{n}", F.lit(0).cast("long"))).alias(f"{x}{i}") for x in "du" for i, n in enumerate(names)]
    ends = [F.least("disc", "_dlow").alias("low"), F.greatest("fin", "_dhigh").alias("high")]
    labels = joined.select("node_id", "layer", "disc", "fin", *ends, *sets_of)
    return ReachIndex(graph.scratch.save(labels, graph.scratch.place("index")).df)


def decide(graph, index: ReachIndex | None, pairs: DataFrame, reflexive: bool = True) -> DataFrame:
    """(src, dst, reachable, decided_by) per distinct pair; an unknown id reaches nothing.

    ``decided_by`` is "id" (equal or unknown ids), "layer", "interval", "hull", "bits", or "sweep" for a pair that the index leaves open. Without
    an index all pairs are walked ("walk").
    """
    asked = pairs.select("src", "dst").distinct()
    if index is None:
        return can_reach(graph, asked, reflexive).withColumn("decided_by", F.lit("walk"))
    source = index.labels.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in index.labels.columns[1:]])
    target = index.labels.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in index.labels.columns[1:]])
    placed = asked.join(source, "src", "left").join(target, "dst", "left")
    unknown = F.col("a_layer").isNull() | F.col("b_layer").isNull()
    lacking = F.lit(False)
    for i in range(SET_WORDS):
        # What the target reaches, the source does as well; what reaches the source, reaches the target.
        lacking = lacking | (F.col(f"b_d{i}").bitwiseAND(F.bitwise_not(f"a_d{i}")) != 0) | (F.col(f"a_u{i}").bitwiseAND(F.bitwise_not(f"b_u{i}")) != 0)
    by = (
        F.when(unknown | (F.col("src") == F.col("dst")), "id")
        .when(F.col("b_layer") <= F.col("a_layer"), "layer")
        .when((F.col("a_disc") <= F.col("b_disc")) & (F.col("b_fin") <= F.col("a_fin")), "interval")
        .when((F.col("b_disc") < F.col("a_low")) | (F.col("b_fin") > F.col("a_high")), "hull")
        .when(lacking, "bits")
    )
    sure = F.when(by == "id", ~unknown & F.lit(reflexive)).when(by.isNotNull(), by == "interval")
    first = graph.scratch.save(placed.select("src", "dst", sure.alias("sure"), by.alias("by")), graph.scratch.place("decided"), figures={"open": F.count_if(F.col("by").isNull())})
    if not first.figures["open"]:
        return first.df.select("src", "dst", F.col("sure").alias("reachable"), F.col("by").alias("decided_by"))
    open_ = first.df.filter(F.col("by").isNull()).select("src", "dst")
    found = swept_pairs(graph, open_).withColumnRenamed("hit", "_hit")
    joined = first.df.join(found, ["src", "dst"], "left")
    return joined.select("src", "dst", F.coalesce("sure", "_hit").alias("reachable"), F.coalesce("by", F.lit("sweep")).alias("decided_by"))
