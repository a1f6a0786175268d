"""Ingest rules: defaults, last write wins, refusals, edits."""

from __future__ import annotations

import pytest
from fixtures import ids

from heirline import InvalidCatalog, LineageGraph
from heirline.functions import clamp_weight, content_of, content_text, own_payload, risk_level, type_rank
from heirline.operators import lookup, risk, topo
from heirline.sources import (
    apply_edits,
    clean_edges,
    clean_nodes,
    clean_seeds,
    demo_catalog,
    invalid_edges,
    missing_seeds,
    problems,
    synthetic_dag,
)
from pyspark.sql import functions as F

NODE = "node_id string, node_type string, content map<string,string>, seq long"
EDGE = "src string, dst string, weight double, seq long"


def models(spark, *names):
    return spark.createDataFrame([(n, "model", {"x": "1"}, 0) for n in names], NODE)


def test_last_write_wins_and_defaults(spark):
    rows = [("a", "model", {"v": "1"}, 1), ("a", "tool", {"v": "2"}, 3), ("a", "model", {"v": "0"}, 2), ("b", "model", None, 0)]
    found = {r.node_id: r for r in clean_nodes(spark.createDataFrame(rows, NODE)).collect()}
    assert (found["a"].node_type, found["a"].content, found["a"].creator) == ("tool", {"v": "2"}, "unknown")
    assert found["b"].content == {}


def test_edge_rules(spark):
    rows = [("a", "b", 0.3, 0), ("a", "b", 0.6, 1), ("b", "c", None, 0), ("c", "d", 1.7, 0), ("d", "e", -0.2, 0)]
    found = {(r.src, r.dst): r.weight for r in clean_edges(spark.createDataFrame(rows, EDGE)).collect()}
    assert found == {("a", "b"): 0.6, ("b", "c"): 0.9, ("c", "d"): 1.0, ("d", "e"): 0.0}


def test_reingest_keeps_edges(spark):
    nodes = models(spark, "a", "b").unionByName(spark.createDataFrame([("a", "tool", {"x": "2"}, 9)], NODE))
    graph = LineageGraph(nodes, spark.createDataFrame([("a", "b", 0.5, 0)], EDGE))
    assert graph.node_count == 2 and graph.edge_count == 1
    assert {r.node_id: r.node_type for r in graph.nodes.collect()} == {"a": "tool", "b": "model"}
    found = lookup.children(graph, ids(spark, "a", "zz")).collect()
    assert [(r.node_id, r.child, r.weight) for r in found] == [("a", "b", 0.5)]


@pytest.mark.parametrize(
    ("nodes", "edges", "text"),
    [
        ([("x", "bad_type", {}, 0)], [], "bad_type"),
        ([("a", "model", {}, 0)], [("a", "nonexistent", 0.9, 0)], "target not found"),
        ([("a", "model", {}, 0)], [("lost", "a", 0.9, 0)], "source not found"),
        ([("a", "model", {}, 0), ("b", "model", {}, 0)], [("a", "b", float("nan"), 0)], "not a number"),
    ],
)
def test_refused(spark, nodes, edges, text):
    frames = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    with pytest.raises(InvalidCatalog, match=text):
        LineageGraph(*frames)
    assert problems(*[clean(f) for clean, f in zip((clean_nodes, clean_edges), frames, strict=True)]).count() == 1


def test_invalid_edges_names_them(spark):
    edges = clean_edges(spark.createDataFrame([("a", "b", 0.1, 0), ("a", "q", 0.1, 0)], EDGE))
    found = invalid_edges(edges, clean_nodes(models(spark, "a", "b"))).collect()
    assert [(r.src, r.dst, r.problem) for r in found] == [("a", "q", "target not found")]


def test_extended(spark, graphs):
    graph = graphs("facade")
    more = graph.extended(
        spark.createDataFrame([("q", "product", {"n": "q"}, 0), ("t", "tool", {"n": "new"}, 0)], NODE),
        spark.createDataFrame([("m", "q", 0.5, 0), ("t", "m", 0.1, 0)], EDGE),
    )
    assert (more.node_count, more.edge_count, graph.node_count, graph.edge_count) == (5, 4, 4, 3)
    kept = {(r.src, r.dst): r.weight for r in more.edges.collect()}
    assert kept == {("ds", "m"): 0.9, ("t", "m"): 0.1, ("m", "p"): 0.95, ("m", "q"): 0.5}
    assert {r.node_id: r.content["n"] for r in more.nodes.collect()}["t"] == "new"
    with pytest.raises(InvalidCatalog, match="cycle"):
        _ = graph.extended(edges=spark.createDataFrame([("p", "ds", 0.5, 0)], EDGE)).layers


def test_cycle(spark):
    nodes = models(spark, "a", "b", "c", "below", "free")
    edges = [("a", "b", 0.9, 0), ("b", "c", 0.9, 0), ("c", "a", 0.9, 0), ("c", "below", 0.9, 0)]
    graph = LineageGraph(nodes, spark.createDataFrame(edges, EDGE))
    with pytest.raises(InvalidCatalog, match="1 of 5 vertices ordered.*a, below, b, c|1 of 5 vertices ordered.*a, b, below, c"):
        _ = graph.layers
    assert {r.node_id for r in topo.cycle_nodes(graph).collect()} == {"a", "b", "c", "below"}


def test_no_roots_at_all(spark):
    graph = LineageGraph(models(spark, "a", "b"), spark.createDataFrame([("a", "b", 0.9, 0), ("b", "a", 0.9, 0)], EDGE))
    assert {r.node_id for r in topo.cycle_nodes(graph).collect()} == {"a", "b"}


def test_no_edges(spark):
    graph = LineageGraph(models(spark, "a", "b"), spark.createDataFrame([], EDGE))
    assert {r.node_id: r.layer for r in graph.layers.collect()} == {"a": 0, "b": 0}
    assert graph.hashes.count() == 2
    assert topo.cycle_nodes(graph).count() == 0


def test_seeds(spark, graphs):
    seeds = spark.createDataFrame([("a", None), ("b", 0.4)], "node_id string, probability double")
    assert {r.node_id: r.probability for r in clean_seeds(seeds).collect()} == {"a": 1.0, "b": 0.4}
    graph = graphs("facade")
    assert [r.node_id for r in missing_seeds(ids(spark, "ds", "zz"), graph.nodes).collect()] == ["zz"]
    with pytest.raises(InvalidCatalog, match="zz"):
        risk.propagate(graph, ids(spark, "ds", "zz"))
    with pytest.raises(InvalidCatalog, match="probabilities"):
        risk.propagate(graph, spark.createDataFrame([("ds", 1.5)], "node_id string, probability double"))


def test_edits(spark):
    nodes = clean_nodes(models(spark, "a", "b"))
    edits = spark.createDataFrame(
        [("a", "x", "2", 1), ("a", "x", "3", 2), ("a", "y", "new", 0), ("zz", "x", "1", 0)],
        "node_id string, key string, value string, seq long",
    )
    found = {r.node_id: r.content for r in apply_edits(nodes, edits).collect()}
    assert found == {"a": {"x": "3", "y": "new"}, "b": {"x": "1"}}


def test_functions(spark):
    row = spark.range(1).select(
        clamp_weight(F.lit(1.7)).alias("high"),
        clamp_weight(F.lit(-0.2)).alias("low"),
        content_of(b=1, a="x", c=25.6, d=True).alias("content"),
        content_text(content_of(b=1, a="x")).alias("text"),
        content_text(content_of()).alias("empty"),
        F.array(*[risk_level(F.lit(x)) for x in (0.9, 0.75, 0.6, 0.5, 0.3, 0.25, 0.1, 0.0)]).alias("levels"),
        F.array(*[type_rank(F.lit(x)) for x in ("product", "model", "tool", "dataset", "?")]).alias("ranks"),
    ).first()
    assert (row.high, row.low, row.text, row.empty) == (1.0, 0.0, "a=x;b=1;", "")
    assert row.content == {"b": "1", "a": "x", "c": "25.6", "d": "true"}
    assert row.levels == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "SAFE"]
    assert row.ranks == [0, 1, 2, 3, 9]


def test_demo_payload(spark):
    nodes, edges = demo_catalog(spark)
    assert (nodes.count(), edges.count()) == (23, 31)
    text = own_payload(F.col("node_id"), F.col("node_type"), F.col("creator"), F.col("content"))
    assert nodes.filter("node_id = 'ds_imagenet'").select(text).first()[0] == (
        "nodeId=ds_imagenet;nodeType=dataset;creator=ImageNet-Team;"
        "name=ImageNet-1K;samples=1281167;sizeGb=138;source=image-net.org;version=2012;"
    )


@pytest.mark.parametrize("size", [100, 500])
def test_synthetic(spark, size):
    nodes, edges = synthetic_dag(spark.range(size).toDF("i"), size)
    assert nodes.count() == size
    assert edges.count() == size - 1 + min(2 * size, 5000)
    assert edges.select("src", "dst").distinct().count() == edges.count()
    ahead = edges.select((F.split("dst", "_")[1].cast("int") - F.split("src", "_")[1].cast("int")).alias("d"), "weight")
    low, high, least, most = ahead.agg(F.min("d"), F.max("d"), F.min("weight"), F.max("weight")).first()
    assert (low, high) == (1, 10) and least >= 0.3 and most < 1.0


def test_weights_and_existence(spark, graphs):
    graph = graphs("seven")
    pairs = spark.createDataFrame([("ds1", "m1"), ("m1", "ds1"), ("sc1", "m1")], "src string, dst string")
    found = {(r.src, r.dst): r.weight for r in lookup.edge_weights(graph.edges, pairs).collect()}
    assert found == {("ds1", "m1"): 0.9, ("m1", "ds1"): 0.9, ("sc1", "m1"): 0.7}
    assert {r.node_id: r.known for r in lookup.exists(graph.nodes, ids(spark, "m1", "q")).collect()} == {"m1": True, "q": False}
    assert [r.parent for r in lookup.parents(graph, ids(spark, "m1")).orderBy("parent").collect()] == ["ds1", "sc1"]
    assert [r.node_id for r in lookup.lookup(graph.nodes, ids(spark, "m1", "q")).collect()] == ["m1"]
