"""Deep graphs: the tail is done piece by piece, with the same results."""

from __future__ import annotations

import random

import pytest
from fixtures import Brute, Fixture, ids, pairs_of, random_fixture, seeds_of

from heirline import InvalidCatalog, LineageGraph
from heirline.operators import labels, reach, risk, topo


def deep_fixture() -> Fixture:
    """A random graph with two long chains below it, one of them with shortcuts."""
    base = random_fixture(5)
    nodes, edges = list(base.nodes), list(base.edges)
    for name, start, length in (("x", base.nodes[0][0], 30), ("y", base.nodes[3][0], 12)):
        chain = [f"{name}{i:02d}" for i in range(length)]
        nodes += [(n, "model", {"k": n}) for n in chain]
        edges += [(start, chain[0], 0.9)]
        edges += [(a, b, 0.95) for a, b in zip(chain, chain[1:], strict=False)]
    edges += [(f"x{i:02d}", f"x{i + 5:02d}", 0.5) for i in range(0, 25, 3)]
    edges += [(base.nodes[5][0], "x20", 0.4)]
    return Fixture(nodes, edges, {**base.seeds, "y05": 0.8})


@pytest.mark.parametrize("piece_rows", [200_000, 20])
def test_tail_gives_the_same(spark, piece_rows):
    fixture = deep_fixture()
    brute = Brute(fixture)
    graph = LineageGraph(*fixture.frames(spark), deep_after=3, piece_rows=piece_rows)
    assert {r.node_id: r.layer for r in graph.layers.collect()} == brute.layer
    assert graph.tail is not None and graph.depth == max(brute.layer.values()) + 1
    assert (graph.rounds < 10) == (piece_rows > 100)
    assert {r.node_id: r.hash for r in graph.hashes.collect()} == brute.hashes()
    names = ["x00", "x29", "y11", fixture.nodes[0][0], fixture.nodes[3][0]]
    for forward, direction in ((True, "forward"), (False, "backward")):
        for limit in (None, 9) if piece_rows > 100 else (None,):
            rows = reach.reached(graph, ids(spark, *names), direction, limit).collect()
            want = {(s, n): h for s in names for n, h in brute.hops(s, forward).items() if h <= (limit or h)}
            assert {(r.query_id, r.node_id): r.hops for r in rows} == want
            assert len(rows) == len(want)
    asked = [(names[3], "x29"), (names[3], "x13"), ("x00", "x29"), ("x29", "x00"), (names[0], "y11")]
    answers = {(r.src, r.dst): r.reachable for r in reach.can_reach(graph, pairs_of(spark, *asked)).collect()}
    assert answers == {(a, b): b in brute.hops(a) for a, b in asked}
    scores = risk.propagate(graph, seeds_of(spark, fixture))
    assert {r.node_id: r.risk for r in scores.collect()} == pytest.approx(brute.risks(), abs=1e-12)


def test_cycle_in_the_tail(spark):
    fixture = deep_fixture()
    fixture.edges.append(("x25", "x20", 0.5))
    graph = LineageGraph(*fixture.frames(spark), deep_after=3)
    with pytest.raises(InvalidCatalog, match="x20"):
        _ = graph.layers
    assert {r.node_id for r in topo.cycle_nodes(graph).collect()} == {f"x{i}" for i in range(20, 30)}


def test_labels_of_a_long_chain(spark):
    names = [f"c{i:03d}" for i in range(100)]
    edges = [(a, b, 0.9) for a, b in zip(names, names[1:], strict=False)]
    graph = LineageGraph(*Fixture([(n, "model", {}) for n in names], edges, {}).frames(spark))
    marks = {r.node_id: (r.disc, r.fin) for r in labels.interval_labels(graph).collect()}
    assert marks == {n: (i + 1, 200 - i) for i, n in enumerate(names)}


def test_large_pieces_are_cut(spark):
    """A deep piece above the limit takes no round per layer, with the same layers and the same vertices below a cycle."""
    names = [f"c{i:03d}" for i in range(120)]
    edges = [(a, b, 0.9) for a, b in zip(names, names[1:], strict=False)]
    edges += [(names[i], names[i + 2], 0.5) for i in range(0, 117, 5)] + [(names[7], names[100], 0.5)]
    # Vertices of lower layers that lead into the middle, and one that hangs on it.
    nodes = [*names, "r0", "r1", "z0"]
    edges += [("r0", "r1", 0.5), ("r1", "c075", 0.5), ("c060", "z0", 0.5)]
    for back in ([], [("c065", "c055", 0.5)]):
        fixture = Fixture([(n, "model", {}) for n in nodes], [*edges, *back], {})
        graph = LineageGraph(*fixture.frames(spark), deep_after=2, piece_rows=60)
        kept, save = [], graph.scratch.save
        graph.scratch.save = lambda df, path, kept=kept, save=save, **options: kept.append(path) or save(df, path, **options)
        if back:
            below = {n for n in names if n >= "c055"} | {"z0"}
            assert {r.node_id for r in topo.cycle_nodes(graph).collect()} == below
        else:
            assert {r.node_id: r.layer for r in graph.layers.collect()} == Brute(fixture).layer
            assert graph.depth == 120 and graph.tail is None
        assert sum("/layer=" in path for path in kept) < 10
        assert any("smaller" in path for path in kept)


def test_labels_by_level_are_those_by_doubling(spark, monkeypatch):
    """A forest of few levels is labelled level by level, a deeper one by doubling, with the same labels."""
    rng = random.Random(21)
    names = [f"v{i}" for i in range(300)]
    edges = sorted({(names[rng.randrange(i)], names[i]) for i in range(20, 300) for _ in range(2)})
    nodes = spark.createDataFrame([(n, "dataset") for n in names], "node_id string, node_type string")
    graph = LineageGraph(nodes, spark.createDataFrame([(a, b, 0.5) for a, b in edges], "src string, dst string, weight double"))
    forest = graph.scratch.save(labels.spanning_forest(graph), graph.scratch.place("forest"))
    levels = labels.forest_levels(graph, forest)
    assert len(levels) > 2 and sum(rows.count() for rows in levels) == 300
    got = {tuple(r) for r in labels.interval_labels(graph).collect()}
    monkeypatch.setattr(labels, "MOST_LEVELS", 1)
    assert labels.forest_levels(graph, forest) is None
    assert got == {tuple(r) for r in labels.interval_labels(graph).collect()} and len(got) == 300
