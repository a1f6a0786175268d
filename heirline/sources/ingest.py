"""Batch ingest: defaults, last write wins, validation and content edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.functions.scalar import clamp_weight
from heirline.schema import ARTIFACT_TYPES, DEFAULT_CREATOR, DEFAULT_WEIGHT, EDGES, EDITS, NODES


class InvalidCatalog(ValueError):
    """Raised when a catalog breaks a rule; the message shows a few offending rows."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; columns not given read null."""
    given = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def latest(df: DataFrame, keys: list[str], tie: list) -> DataFrame:
    """The row with the highest ``seq`` of every key.

    An aggregation and not a window: rows of a key that was written very often are
    reduced before the shuffle. ``tie`` makes equal ``seq`` values repeatable.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.coalesce("seq", F.lit(0)).alias("s"), F.xxhash64(*tie).alias("t"))
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_kept"))
    return kept.select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_nodes(df: DataFrame, *, unique: bool = False) -> DataFrame:
    """Artifacts with defaults filled in, one row per id.

    ``unique=True`` states that ids do not repeat and saves the shuffle.
    """
    rows = conform(df, NODES).withColumns(
        {
            "content": F.coalesce("content", F.create_map().cast("map<string,string>")),
            "creator": F.coalesce("creator", F.lit(DEFAULT_CREATOR)),
        }
    )
    if unique:
        return rows
    return latest(rows, ["node_id"], ["node_type", "creator", F.map_entries("content")])


def clean_edges(df: DataFrame, *, unique: bool = False) -> DataFrame:
    """Edges with the default weight, weights limited to [0, 1], one row per pair.

    NaN is kept as it is, for :func:`invalid_edges` to report.
    """
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT))
    rows = conform(df, EDGES).withColumn(
        "weight", F.when(F.isnan(weight), weight).otherwise(clamp_weight(weight))
    )
    return rows if unique else latest(rows, ["src", "dst"], ["weight"])


def clean_seeds(df: DataFrame) -> DataFrame:
    """Seeds with probability 1.0 where none is given, one row per id."""
    given = "probability" in df.columns
    value = F.col("probability").cast("double") if given else F.lit(None).cast("double")
    rows = df.select("node_id", F.coalesce(value, F.lit(1.0)).alias("probability"))
    return rows.groupBy("node_id").agg(F.max("probability").alias("probability"))


def bad_artifact() -> Column:
    """True for a row without an id or with a type outside the set."""
    known = F.coalesce(F.col("node_type").isin(*ARTIFACT_TYPES), F.lit(False))
    return ~known | F.col("node_id").isNull()


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """(subject, problem) of artifacts without an id or with a type outside the set."""
    return nodes.filter(bad_artifact()).select(
        F.col("node_id").alias("subject"),
        F.concat(F.lit("artifact type not allowed: "), F.coalesce("node_type", F.lit("null"))).alias("problem"),
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that edges name and ``nodes`` lacks; each id is looked up once."""
    ids = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return ids.distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def invalid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, problem) of edges with an unknown end or a weight that is no number."""
    lost = missing_endpoints(edges, nodes)
    by_src = edges.join(lost.withColumnRenamed("node_id", "src"), "src", "left_semi")
    by_dst = edges.join(lost.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    nan = edges.filter(F.isnan("weight"))
    return (
        by_src.select("src", "dst", F.lit("source not found").alias("problem"))
        .unionByName(by_dst.select("src", "dst", F.lit("target not found").alias("problem")))
        .unionByName(nan.select("src", "dst", F.lit("weight is not a number").alias("problem")))
    )


def missing_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seed ids that are not in the catalog."""
    return seeds.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All broken rules as (subject, problem)."""
    edge_rows = invalid_edges(edges, nodes).select(F.concat_ws(" -> ", "src", "dst").alias("subject"), "problem")
    return invalid_nodes(nodes).unionByName(edge_rows)


def require_none(rows: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with a few sample rows if ``rows`` holds any."""
    sample = rows.take(shown)
    if sample:
        raise InvalidCatalog(f"{what}: " + "; ".join(", ".join(str(v) for v in row) for row in sample))


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Set content entries; per (node_id, key) the edit with the highest ``seq`` counts."""
    last = latest(conform(edits, EDITS), ["node_id", "key"], ["value"])
    maps = last.groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_edits")
    )
    kept = F.map_filter("content", lambda k, _: ~F.array_contains(F.map_keys("_edits"), k))
    merged = F.when(F.col("_edits").isNull(), F.col("content")).otherwise(F.map_concat(kept, "_edits"))
    return nodes.join(maps, "node_id", "left").withColumn("content", merged).drop("_edits").select(*nodes.columns)
