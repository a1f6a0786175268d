"""Plans and layouts: what a walk reads, and limits that a large catalog must not meet."""

from __future__ import annotations

import pytest
from fixtures import FIXTURES, ids, random_fixture
from pyspark.sql import functions as F

from heirline import LineageGraph
from heirline.operators import reach
from heirline.plans import frontier
from heirline.plans.scratch import Scratch


@pytest.fixture
def sixteen_buckets(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_listed_frontier_reads_only_its_buckets(spark, sixteen_buckets):
    graph = LineageGraph(*random_fixture(3).frames(spark))
    names = [r.node_id for r in graph.nodes.orderBy("node_id").limit(3).collect()]
    scratch = Scratch(spark)
    rows = scratch.save(ids(spark, *names).selectExpr("node_id AS query_id", "node_id"), scratch.place("frontier"))
    listed = frontier.short_id_list(rows)
    assert listed == names

    def files(table) -> int:
        """One task per file, as opening one counts like a full partition."""
        before = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
        try:
            return table.select("far").rdd.getNumPartitions()
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", before)

    table = graph.forward.table
    assert 1 <= files(table.filter(F.col("near").isin(listed))) <= 3 < files(table)
    assert frontier.short_id_list(rows, limit=2) is None


def test_long_and_short_frontiers_agree(spark, monkeypatch):
    graph = LineageGraph(*random_fixture(4).frames(spark))
    starts = graph.nodes.select("node_id")

    def rows():
        return sorted(tuple(r) for r in reach.reached(graph, starts, "forward").collect())

    listed = rows()
    monkeypatch.setattr(frontier.short_id_list, "__defaults__", (0,))
    assert rows() == listed


def test_bucket_count_stays_within_spark(spark, monkeypatch):
    graph = LineageGraph(*FIXTURES["diamond"].frames(spark))
    monkeypatch.setattr(LineageGraph, "edge_count", property(lambda _: 10**13))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    assert graph.buckets == most
