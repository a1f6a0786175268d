"""Answers to whole questions about a catalog, each as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.operators.impact import impacted, lineage, result_rows, totals
from heirline.operators.labels import labels_of
from heirline.operators.merkle import Proof, parent_lists, verify
from heirline.operators.reach import can_reach, starts
from heirline.operators.reachindex import ReachIndex, decide
from heirline.operators.risk import propagate, risk_summary, top_risks
from heirline.schema import TOP_RISKS


def build_summary(graph) -> DataFrame:
    """One row (nodes, edges, layers, hashed): checks the order and computes all hashes."""
    hashed = graph.hashes.agg(F.count("hash").alias("hashed"))
    return hashed.select(
        F.lit(graph.node_count).cast("long").alias("nodes"),
        F.lit(graph.edge_count).cast("long").alias("edges"),
        F.lit(graph.depth).alias("layers"),
        "hashed",
    )


def compromise(graph, seeds: DataFrame, top: int = TOP_RISKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, summary, ``top`` highest scores) for a set of compromised artifacts."""
    scores = propagate(graph, seeds)
    return scores, risk_summary(scores), top_risks(scores, top)


def impact_query(graph, ids: DataFrame, k: int | None = None, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((source, k, total_impacted), rows) of an impact query."""
    listing = impacted(graph, ids, k, scores)
    head = (
        starts(ids)
        .select("query_id")
        .join(totals(listing), "query_id", "left")
        .select(
            F.col("query_id").alias("source"),
            F.lit(k).cast("int").alias("k"),
            F.coalesce("total", F.lit(0)).alias("total_impacted"),
        )
    )
    return head, result_rows(listing)


def ancestor_query(graph, ids: DataFrame, k: int | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Rows of an ancestor query."""
    return result_rows(lineage(graph, ids, k, scores))


def reach_query(graph, labels: DataFrame, pairs: DataFrame, index: ReachIndex | None = None) -> DataFrame:
    """(src, dst, reachable, src_disc, src_fin, dst_disc, dst_fin); answered from the ``index``, if there is one."""
    answers = can_reach(graph, pairs) if index is None else decide(graph, index, pairs).drop("decided_by")
    for end in ("src", "dst"):
        ids = answers.select(F.col(end).alias("node_id")).distinct()
        ends = labels_of(labels, ids).select(
            F.col("node_id").alias(end), F.col("disc").alias(f"{end}_disc"), F.col("fin").alias(f"{end}_fin")
        )
        answers = answers.join(ends, end)
    return answers.select("src", "dst", "reachable", "src_disc", "src_fin", "dst_disc", "dst_fin")


def proof_report(proof: Proof) -> tuple[DataFrame, DataFrame]:
    """((target, target_hash, chain_length), chain) of every proof."""
    return proof.targets(), proof.chain()


def proof_verdict(proof: Proof, nodes: DataFrame | None = None) -> DataFrame:
    """(target, valid, message) of every proof."""
    return verify(proof, nodes)


def hash_listing(graph) -> DataFrame:
    """(node_id, part, hash, parents) in id order; a vertex without parents has an empty list.

    Lists go on in further parts as in :func:`parent_lists`.
    """
    lists = parent_lists(graph)
    rows = graph.hashes.select("node_id", "hash").join(lists, "node_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "node_id", F.coalesce("part", F.lit(0)).alias("part"), "hash", F.coalesce("parents", none).alias("parents")
    ).orderBy("node_id", "part")


def graph_stats(graph, scores: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """One row: sizes, number of roots, leaves and seeds, and the risk summary if any.

    The members are in ``graph.roots``, ``graph.leaves`` and ``seeds``: such lists
    grow with the catalog and do not belong in one row.
    """
    figures = graph.degrees.figures
    seeded = 0 if seeds is None else seeds.select("node_id").distinct().count()
    row = graph.spark.createDataFrame(
        [(graph.node_count, graph.edge_count, figures["roots"], figures["leaves"], seeded)],
        "total_nodes long, total_edges long, root_nodes long, leaf_nodes long, compromised_nodes long",
    )
    if scores is None:
        return row
    summary = risk_summary(scores).select("mean_risk", "max_risk", "min_risk", "level_counts")
    return row.join(F.broadcast(summary), how="left")
