"""Edges laid out for repeated joins from one end, with hot vertices split.

A vertex whose degree exceeds a limit is hot. Its edges are spread over
``ceil(degree / limit)`` salts, and the other side of the join repeats that vertex
once per salt. At most ``edges / limit`` vertices can be hot, so the table of hot
vertices has a known bound and may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_DEGREE = 200_000
# Hot vertices are broadcast: an id and a count each, so some ten megabytes at most with ids of 100 bytes.
MAX_HOT_VERTICES = 100_000


def hot_limit(edge_rows: int, hot_degree: int = HOT_DEGREE) -> int:
    """Degree above which a vertex is split; keeps the hot table within its bound."""
    return max(hot_degree, -(-edge_rows // MAX_HOT_VERTICES))


def hot_vertices(degrees: DataFrame, limit: int) -> DataFrame:
    """(node_id, parts) of the vertices above the limit, from (node_id, degree)."""
    return degrees.filter(F.col("degree") > limit).select(
        "node_id", F.ceil(F.col("degree") / limit).cast("int").alias("parts")
    )


def repeat_hot(df: DataFrame, hot: DataFrame | None, key: str, salt: str) -> DataFrame:
    """Rows of hot vertices once per salt; without hot vertices ``df`` as it is."""
    if hot is None:
        return df
    parts = F.broadcast(hot.select(F.col("node_id").alias("_hot"), F.col("parts").alias("_parts")))
    salts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return (
        df.join(parts, df[key] == parts["_hot"], "left")
        .withColumn(salt, F.explode(salts))
        .drop("_hot", "_parts")
    )


def salt_edges(edges: DataFrame, hot: DataFrame | None, key: str, other: str, salt: str) -> DataFrame:
    """Add the salt of end ``key``, drawn from the id at the ``other`` end."""
    if hot is None:
        return edges
    parts = F.broadcast(hot.select(F.col("node_id").alias("_hot"), F.col("parts").alias("_parts")))
    drawn = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    return edges.join(parts, edges[key] == parts["_hot"], "left").withColumn(salt, drawn).drop("_hot", "_parts")


@dataclass(frozen=True)
class Adjacency:
    """Edges bucketed by one end, called ``near``; the other end is ``far``."""

    table: DataFrame
    hot: DataFrame | None

    def keys(self) -> list[str]:
        return ["near"] if self.hot is None else ["near", "near_salt"]

    def meet(self, side: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Join rows with ``node_id`` to their edges; columns of both sides remain.

        ``only`` is a short list of the ids in ``side``, pushed down to the scan.
        """
        table = self.table if only is None else self.table.filter(F.col("near").isin(only))
        spread = repeat_hot(side, self.hot, "node_id", "_salt").withColumnRenamed("node_id", "_at")
        on = spread["_at"] == table["near"]
        if self.hot is not None:
            on = on & (spread["_salt"] == table["near_salt"])
        return spread.join(table, on)
