"""A lineage catalog read out of a star schema.

region -> nation -> supplier -> part -> order -> customer; line items give the
supplier-part and part-order edges, with weights from discount and quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.functions.scalar import clamp_weight

# Node id prefix, artifact type, key and name column of every table.
VERTEX_TABLES = (
    ("region", "region", "tool", "r_regionkey", "r_name"),
    ("nation", "nation", "tool", "n_nationkey", "n_name"),
    ("supplier", "supplier", "dataset", "s_suppkey", "s_name"),
    ("part", "part", "model", "p_partkey", "p_name"),
    ("orders", "order", "product", "o_orderkey", "o_orderpriority"),
    ("customer", "customer", "product", "c_custkey", "c_name"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def node_key(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


def catalog_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One artifact per row of the six vertex tables."""
    frames = [
        table(spark, folder, name).select(
            node_key(prefix, key).alias("node_id"),
            F.lit(kind).alias("node_type"),
            F.create_map(F.lit("name"), F.col(label)).alias("content"),
        )
        for name, prefix, kind, key, label in VERTEX_TABLES
    ]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def catalog_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, weight); every pair occurs once."""
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")

    def edge(df: DataFrame, src: Column, dst: Column, weight: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), clamp_weight(weight).alias("weight"))

    supplied = lines.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("w"))
    ordered = lines.groupBy("l_partkey", "l_orderkey").agg((F.max("l_quantity") / 50).alias("w"))
    return (
        edge(nation, node_key("region", "n_regionkey"), node_key("nation", "n_nationkey"), F.lit(0.9))
        .unionByName(edge(supplier, node_key("nation", "s_nationkey"), node_key("supplier", "s_suppkey"), F.lit(0.5)))
        .unionByName(edge(supplied, node_key("supplier", "l_suppkey"), node_key("part", "l_partkey"), F.col("w")))
        .unionByName(edge(ordered, node_key("part", "l_partkey"), node_key("order", "l_orderkey"), F.col("w")))
        .unionByName(edge(orders, node_key("order", "o_orderkey"), node_key("customer", "o_custkey"), F.lit(0.9)))
    )


def catalog_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with a negative balance, each certain to be compromised."""
    return (
        table(spark, folder, "supplier")
        .filter(F.col("s_acctbal") < 0)
        .select(node_key("supplier", "s_suppkey").alias("node_id"), F.lit(1.0).alias("probability"))
    )


def part_blocks(spark: SparkSession, folder: str, width: int = 16) -> tuple[DataFrame, DataFrame]:
    """A deeper graph: parts in blocks of ``width``, edges 1, 3 and 7 keys ahead."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("p"), "p_name")
    nodes = parts.select(
        node_key("part", "p").alias("node_id"),
        F.lit("model").alias("node_type"),
        F.create_map(F.lit("name"), F.col("p_name")).alias("content"),
    )
    ahead = parts.select("p", F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("step")).withColumn(
        "q", F.col("p") + F.col("step")
    )
    same = F.floor(F.col("p") / width) == F.floor(F.col("q") / width)
    known = parts.select(F.col("p").alias("q"))
    edges = (
        ahead.filter(same)
        .join(known, "q", "left_semi")
        .select(node_key("part", "p").alias("src"), node_key("part", "q").alias("dst"), F.lit(0.9).alias("weight"))
    )
    return nodes, edges
