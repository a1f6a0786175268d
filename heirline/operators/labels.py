"""Interval labels on a spanning forest.

Every vertex keeps its least parent. An interval that lies within another tells that
the vertex is reachable; the reverse does not hold, as a forest leaves edges out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.plans.prefix import running_total
from heirline.plans.scratch import Stored

# Deeper forests are labelled by doubling.
MOST_LEVELS = 16


def spanning_forest(graph) -> DataFrame:
    """(node_id, parent); parent is null for roots."""
    chosen = graph.edges.groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
    return graph.nodes.select("node_id").join(chosen, "node_id", "left")


def _jump(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with ``jump`` moved to the jump of the vertex it points at, named ``_there``."""
    ahead = rows.select(F.col("node_id").alias("_there"), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != "node_id"])
    return rows.join(ahead, rows["jump"] == ahead["_there"], "left").select(
        *[columns.get(c, F.col(c)).alias(c) for c in rows.columns]
    )


def subtree_sizes(graph, forest: DataFrame) -> DataFrame:
    """(node_id, parent, size) by doubling.

    ``size`` counts the descendants nearer than a distance that doubles each round:
    those known so far, plus what the vertices exactly that far below know. The rounds
    are the logarithm of the depth.
    """
    scratch = graph.scratch
    begin = forest.withColumns({"jump": F.col("parent"), "size": F.lit(1).cast("long")})
    open_rows = {"open": F.count("jump")}
    now = scratch.save(begin, scratch.place("sizes"), figures=open_rows)
    while now.figures["open"]:
        below = now.df.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("_at")).agg(F.sum("size").alias("_below"))
        jumped = _jump(now.df, {"jump": F.col("_jump")})
        grown = jumped.join(below, jumped["node_id"] == below["_at"], "left")
        size = F.col("size") + F.coalesce("_below", F.lit(0))
        now = scratch.save(
            grown.select("node_id", "parent", "jump", size.alias("size")), scratch.place("sizes"), figures=open_rows
        )
    return now.df.drop("jump")


def forest_levels(graph, forest: Stored) -> list[DataFrame] | None:
    """(node_id, parent) of the vertices so many steps below a root, from 0 on; None if there are more than ``MOST_LEVELS`` or ids repeat.

    Children are bucketed by their parent, so only the vertices of a level are shuffled.
    """
    if graph.node_count != graph.degrees.rows or graph.degrees.figures["unknown"]:
        return None
    scratch = graph.scratch
    children = forest.df.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("near"), F.col("node_id").alias("far"))
    children = scratch.save_bucketed(children, "children", ["near"], graph.buckets)
    level = scratch.save(forest.df.filter(F.col("parent").isNull()), scratch.place("level"))
    levels, open_rows = [], forest.rows
    while level.rows and len(levels) < MOST_LEVELS:
        levels.append(level.df)
        open_rows -= level.rows
        if not open_rows:
            break
        met = level.df.select("node_id").join(children, F.col("node_id") == F.col("near"))
        level = scratch.save(met.select(F.col("far").alias("node_id"), F.col("near").alias("parent")), scratch.place("level"))
    return None if open_rows else levels


def _labels_by_level(graph, levels: list[DataFrame]) -> DataFrame:
    """The labels of a forest of few levels: sizes from below, starts from above. So a vertex is met once on each way, not in every round of a doubling."""
    scratch = graph.scratch
    sized, below = [], None
    for number in range(len(levels) - 1, -1, -1):
        rows, size = levels[number], F.lit(1).cast("long")
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("_at")).agg(F.sum("size").alias("_below"))
            rows, size = rows.join(sums, F.col("node_id") == F.col("_at"), "left"), size + F.coalesce("_below", F.lit(0))
        below = scratch.save(rows.select("node_id", "parent", size.alias("size")), scratch.place("sizes")).df
        sized.append(below.withColumn("level", F.lit(number)))
    placed = running_total(scratch, reduce(DataFrame.unionByName, sized), ["node_id"], F.col("size") * 2, "offset", group=["parent"])
    begun = scratch.save(placed, scratch.place("offsets"), partition_by=("level",))
    row = T.StructType([T.StructField(f.name, f.dataType) for f in begun.df.schema if f.name != "level"])
    base, schema = scratch.place("labels"), None
    above = None
    for number in range(len(levels)):
        rows, disc = scratch.read(f"{begun.path}/level={number}", row), F.col("offset") + 1
        if above is not None:
            rows, disc = rows.join(above.select(F.col("node_id").alias("_at"), F.col("disc").alias("_disc")), F.col("parent") == F.col("_at")), disc + F.col("_disc")
        above = scratch.save(rows.select("node_id", disc.alias("disc"), (disc + 2 * F.col("size") - 1).alias("fin")), f"{base}/level={number}").df
        schema = schema or above.schema
    return scratch.read(base, schema).select("node_id", "disc", "fin")


def interval_labels(graph) -> DataFrame:
    """(node_id, disc, fin): nested-set labels, children and roots in id order.

    A vertex starts one after its parent, plus the room of its earlier siblings. Summed
    along the way to the root, level by level or in a deep forest by doubling, that is its own start.
    """
    scratch = graph.scratch
    forest = scratch.save(spanning_forest(graph), scratch.place("forest"))
    levels = forest_levels(graph, forest)
    if levels:
        return _labels_by_level(graph, levels)
    sized = subtree_sizes(graph, forest.df)
    placed = running_total(scratch, sized, ["node_id"], F.col("size") * 2, "offset", group=["parent"])
    begin = placed.select("node_id", F.col("parent").alias("jump"), "size", (F.col("offset") + 1).alias("disc"))
    open_rows = {"open": F.count("jump")}
    now = scratch.save(begin, scratch.place("labels"), figures=open_rows)
    while now.figures["open"]:
        disc = F.col("disc") + F.coalesce("_disc", F.lit(0))
        moved = _jump(now.df, {"jump": F.col("_jump"), "disc": disc})
        now = scratch.save(moved, scratch.place("labels"), figures=open_rows)
    return now.df.select("node_id", "disc", (F.col("disc") + 2 * F.col("size") - 1).alias("fin"))


def labels_of(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, disc, fin, indexed) per id; -1 for an id without labels."""
    return (
        ids.select("node_id")
        .join(labels, "node_id", "left")
        .withColumn("indexed", F.col("disc").isNotNull())
        .na.fill(-1, ["disc", "fin"])
    )


def contained(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, contained) per pair: does the interval of dst lie within that of src."""
    outer = labels.select(F.col("node_id").alias("src"), F.col("disc").alias("_d"), F.col("fin").alias("_f"))
    inner = labels.select(F.col("node_id").alias("dst"), "disc", "fin")
    within = (F.col("_d") <= F.col("disc")) & (F.col("fin") <= F.col("_f"))
    return (
        pairs.select("src", "dst")
        .join(outer, "src", "left")
        .join(inner, "dst", "left")
        .select("src", "dst", F.coalesce(within, F.lit(False)).alias("contained"))
    )


def enclosed(labels: DataFrame, ids: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(query_id, node_id) of everything inside the interval of each id, itself left out.

    A range join by equality: an interval is cut at every multiple of ``width``, so a
    wide one is shared out over many keys and no key holds more than ``width`` labels.
    """
    outer = ids.select("node_id").distinct().join(labels, "node_id")
    cells = F.explode(F.sequence(F.floor(F.col("disc") / width), F.floor(F.col("fin") / width))).alias("_cell")
    cut = outer.select(F.col("node_id").alias("query_id"), F.col("disc").alias("_d"), F.col("fin").alias("_f"), cells)
    inner = labels.withColumn("_cell", F.floor(F.col("disc") / width))
    within = (F.col("_d") < F.col("disc")) & (F.col("fin") <= F.col("_f"))
    return cut.join(inner, "_cell").filter(within).select("query_id", "node_id")
