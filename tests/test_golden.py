"""Known results of the five small graphs, and random graphs against plain Python."""

from __future__ import annotations

from functools import reduce

import pytest
from fixtures import FIXTURES, Brute, ids, pairs_of, random_fixture, seeds_of
from pyspark.sql import functions as F

from heirline import LineageGraph
from heirline.functions import risk_level
from heirline.operators import labels, merkle, paths, reach, risk, topo


# The fixtures share no edge, so several fit in one catalog as long as no id repeats.
@pytest.mark.parametrize("names", [("seven", "facade", "diamond"), ("chain", "demo")])
def test_layers_hashes_risk_and_closures(spark, names):
    frames = [FIXTURES[n].frames(spark) for n in names]
    nodes, edges = (reduce(lambda a, b: a.unionByName(b, True), side) for side in zip(*frames, strict=True))
    graph = LineageGraph(nodes, edges)
    golden = {k: v for n in names for k, v in FIXTURES[n].golden.items()}
    seeds = spark.createDataFrame([s for n in names for s in FIXTURES[n].seeds.items()], "node_id string, probability double")
    everyone = ids(spark, *golden)
    down = reach.descendants(graph, everyone).groupBy(F.col("query_id").alias("node_id")).agg(F.count("*").alias("down"))
    up = reach.ancestors(graph, everyone).groupBy(F.col("query_id").alias("node_id")).agg(F.count("*").alias("up"))
    rows = (
        graph.nodes.select("node_id", "node_type")
        .join(graph.layers, "node_id")
        .join(graph.hashes, "node_id")
        .join(risk.propagate(graph, seeds), "node_id")
        .join(down, "node_id", "left")
        .join(up, "node_id", "left")
        .na.fill(0, ["down", "up"])
        .withColumn("level", risk_level(F.col("risk")))
        .collect()
    )
    found = {
        r.node_id: (r.node_type, r.layer, r.down, r.up, round(r.risk, 6), r.level, r.hash) for r in rows
    }
    assert found == golden


def test_demo_summary(spark, graphs):
    scores = risk.propagate(graphs("demo"), ids(spark, "ds_imagenet"))
    row = risk.risk_summary(scores).first()
    assert (row.total_nodes, row.mean_risk, row.max_risk, row.min_risk) == (23, 0.3654, 1.0, 0.0)
    assert row.level_counts == {"CRITICAL": 9, "HIGH": 0, "MEDIUM": 0, "LOW": 0, "SAFE": 14}
    counts = {r.risk_level: r.nodes for r in risk.level_counts(scores).collect()}
    assert counts == row.level_counts
    assert [r.node_id for r in risk.top_risks(scores, 3).collect()] == [
        "ds_imagenet",
        "model_classifier_v1",
        "prod_vision_api",
    ]
    assert risk.top_risks(scores, 0).count() == 0
    assert risk.top_risks(scores, -1).count() == 0


# The second run splits every vertex of more than two edges; results must not change.
@pytest.mark.parametrize(("seed", "hot_degree"), [(1, 200_000), (2, 2)])
def test_random_graph(spark, seed, hot_degree):
    fixture = random_fixture(seed)
    brute = Brute(fixture)
    graph = LineageGraph(*fixture.frames(spark), hot_degree=hot_degree)
    assert (graph.hot_sources is None) == (hot_degree > 100)

    assert {r.node_id: r.layer for r in graph.layers.collect()} == brute.layer
    order = [r.node_id for r in topo.topological_order(graph).collect()]
    assert order == brute.order
    hashes = brute.hashes()
    assert {r.node_id: r.hash for r in graph.hashes.collect()} == hashes

    scores = risk.propagate(graph, seeds_of(spark, fixture))
    found = {r.node_id: r.risk for r in scores.collect()}
    assert found == pytest.approx(brute.risks(), abs=1e-12)
    again, _ = risk.diffuse(graph, scores)
    assert {r.node_id: r.risk for r in again.collect()} == pytest.approx(found, abs=1e-9)
    start = seeds_of(spark, fixture).withColumnRenamed("probability", "risk")
    two, done = risk.diffuse(graph, start, rounds=2)
    assert done == 2
    assert {r.node_id: r.risk for r in two.collect()} == pytest.approx(brute.diffused(0.85, 2), abs=1e-12)

    names = sorted(brute.types)
    for forward, direction in ((True, "forward"), (False, "backward")):
        rows = reach.reached(graph, ids(spark, *names), direction).collect()
        want = {(s, n): h for s in names for n, h in brute.hops(s, forward).items()}
        assert {(r.query_id, r.node_id): r.hops for r in rows} == want
        assert len(rows) == len(want)

    asked = [(a, b) for a in names[::3] for b in names[::2]]
    hops = {a: brute.hops(a) for a in names}
    answers = {(r.src, r.dst): r.reachable for r in reach.can_reach(graph, pairs_of(spark, *asked)).collect()}
    assert answers == {(a, b): a == b or b in hops[a] for a, b in asked}
    found_paths = paths.shortest_paths(graph, pairs_of(spark, *asked))
    assert {(r.src, r.dst): r.path for r in found_paths.collect()} == {p: brute.path(*p) for p in asked}
    assert paths.broken_steps(found_paths, graph.edges).count() == 0

    marks = labels.interval_labels(graph)
    placed = {r.node_id: (r.disc, r.fin) for r in marks.collect()}
    assert sorted(x for pair in placed.values() for x in pair) == list(range(1, 2 * len(names) + 1))
    inside = {(r.query_id, r.node_id) for r in labels.enclosed(marks, ids(spark, *names), 8).collect()}
    assert inside == {
        (a, b) for a in names for b in names if placed[a][0] < placed[b][0] and placed[b][1] < placed[a][1]
    }
    assert all(b in hops[a] for a, b in inside)

    proof = merkle.prove(graph, ids(spark, *names[::5]))
    assert {r.target: r.valid for r in merkle.verify(proof).collect()} == {n: True for n in names[::5]}
    sizes = {r.target: r.chain_length for r in proof.targets().collect()}
    assert sizes == {n: 1 + len(brute.hops(n, False)) for n in names[::5]}
    graph.release()


def test_seven_node_labels(spark, graphs):
    marks = {r.node_id: (r.disc, r.fin) for r in labels.interval_labels(graphs("seven")).collect()}
    assert marks == {
        "ds1": (1, 6), "m1": (2, 5), "p1": (3, 4), "ds2": (7, 12), "m2": (8, 11), "p2": (9, 10), "sc1": (13, 14),
    }
