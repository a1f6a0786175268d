"""Closures as bitmaps against walks in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heirline import LineageGraph
from heirline.operators import impact, labels, reach, reachindex
from heirline.plans import bitmaps


def layered(seed: int, layers: int = 5, width: int = 25) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    nodes = [[f"n{i}_{j}" for j in range(width)] for i in range(layers)]
    return [(rng.choice(nodes[rng.randrange(i)]), b) for i in range(1, layers) for b in nodes[i] for _ in range(rng.randrange(3))]


def graph_of(spark, edges, **options):
    names = sorted({n for e in edges for n in e} | {"alone"})
    nodes = spark.createDataFrame([(n, "dataset") for n in names], "node_id string, node_type string")
    return names, LineageGraph(nodes, spark.createDataFrame([(a, b, 0.5) for a, b in edges], "src string, dst string, weight double"), **options)


def beyond(edges, node):
    links, found, todo = defaultdict(set), set(), [node]
    for a, b in edges:
        links[a].add(b)
    while todo:
        for far in links[todo.pop()] - found:
            found.add(far)
            todo.append(far)
    return found


@pytest.mark.parametrize("options", [{}, {"hot_degree": 2}])
def test_closures_counts_and_first_rows(spark, options):
    edges = sorted(set(layered(3)))
    names, graph = graph_of(spark, edges, **options)
    # More starts than a block has bits would take long here; a small block does the same.
    ids = spark.createDataFrame([(n,) for n in [*names, "nobody", names[0]]], "node_id string")
    for direction, links in (("forward", edges), ("backward", [(b, a) for a, b in edges])):
        want = {(n, m) for n in names for m in beyond(links, n)}
        made = bitmaps.closure(graph, ids, direction)
        got = [tuple(r) for r in made.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want
        # Rows are vertices and blocks.
        assert made.reached.count() == len({m for _, m in want})
        kinds = graph.nodes.selectExpr("node_id", "substr(node_id, 1, 2) AS kind")
        counted = {(r.query_id, r.kind): r.n for r in made.counts(kinds).collect()}
        assert counted == {(n, k): sum(m[:2] == k for a, m in want if a == n) for n, k in {(a, m[:2]) for a, m in want}}
        ranked = spark.createDataFrame([(n, i * 7 % len(names)) for i, n in enumerate(names)], "node_id string, place long")
        place = {n: i * 7 % len(names) for i, n in enumerate(names)}
        first = defaultdict(list)
        for r in made.first(ranked, 3).collect():
            first[r.query_id].append(r.place)
        assert {n: sorted(p) for n, p in first.items()} == {n: sorted(place[m] for a, m in want if a == n)[:3] for n in {a for a, _ in want}}


def test_many_blocks(spark):
    """1,100 starts lie in two blocks; all reach the same end."""
    edges = [(f"s{i}", "hub") for i in range(1100)] + [("hub", "end")]
    names, graph = graph_of(spark, edges)
    made = bitmaps.closure(graph, graph.roots, "forward")
    assert made.reached.count() == 4
    assert {tuple(r) for r in reach.descendants(graph, graph.roots).collect()} == {(n, m) for n in names for m in beyond(edges, n)} - {("hub", "end")}
    up = bitmaps.closure(graph, graph.leaves, "backward").pairs()
    assert up.filter("query_id = 'end'").count() == 1101


def test_nothing_to_close(spark):
    _, graph = graph_of(spark, [("a", "b")])
    none = graph.nodes.limit(0)
    assert bitmaps.closure(graph, none, "forward").pairs().collect() == []
    assert bitmaps.closure(graph, graph.leaves, "forward").pairs().collect() == []


def test_index_answers_all_pairs(spark):
    """Every pair of a random graph, and how it was decided."""
    edges = sorted(set(layered(5)))
    names, graph = graph_of(spark, edges)
    index = reachindex.reach_index(graph, labels.interval_labels(graph))
    below = {n: beyond(edges, n) for n in names}
    pairs = [(a, b) for a in names[::2] for b in names] + [("nobody", names[0]), (names[0], "nobody"), ("nobody", "nobody")]
    asked = spark.createDataFrame(pairs, "src string, dst string")
    got = {(r.src, r.dst): r for r in reachindex.decide(graph, index, asked).collect()}
    assert len(got) == len(pairs)
    for (a, b), r in got.items():
        assert r.reachable == (a in below and (a == b or b in below[a])), (a, b, r.decided_by)
    kinds = {r.decided_by for r in got.values()}
    assert kinds >= {"id", "layer", "interval"} and kinds & {"hull", "bits"}
    assert sum(r.decided_by == "sweep" for r in got.values()) < len(pairs) / 10
    # Pairs that only a sweep can tell, from either side; ids are not reached from themselves if so wished.
    blind = reachindex.ReachIndex(index.labels.selectExpr("node_id", "layer", "-disc AS disc", "-fin AS fin", "-999999 AS low", "999999 AS high", *[f"0L AS {x}{i}" for x in "du" for i in range(reachindex.SET_WORDS)]))
    for some in (pairs[:300], [(a, names[-3]) for a in names]):
        swept = reachindex.decide(graph, blind, spark.createDataFrame(some, "src string, dst string"), reflexive=False).collect()
        assert all(r.reachable == (r.dst in below.get(r.src, ())) for r in swept if r.decided_by != "interval") and any(r.decided_by == "sweep" for r in swept)
    unindexed = reachindex.decide(graph, None, spark.createDataFrame(pairs[:20], "src string, dst string")).collect()
    assert {r.decided_by for r in unindexed} == {"walk"} and all(r.reachable == got[r.src, r.dst].reachable for r in unindexed)


def test_reports_are_the_same_from_walks(spark, monkeypatch):
    _, graph = graph_of(spark, sorted(set(layered(7))))
    ids = graph.nodes.select("node_id").filter("node_id < 'n1_2' OR node_id = 'alone'").unionByName(spark.createDataFrame([("nobody",)], "node_id string"))
    scores = graph.nodes.selectExpr("node_id", "round(pmod(xxhash64(node_id), 7) / 7, 3) AS risk")
    swept = sorted(impact.impact_reports(graph, ids, scores, impacted_rows=4, ancestor_rows=2).collect())
    monkeypatch.setattr(impact, "can_push", lambda g: False)
    assert swept == sorted(impact.impact_reports(graph, ids, scores, impacted_rows=4, ancestor_rows=2).collect())


def test_set_bits_of_sparse_and_full_rows():
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63 - 1, (40, bitmaps.WORDS)) * (rng.random((40, bitmaps.WORDS)) < 0.2)
    words[7], words[9] = -1, 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), *[pa.array(w) for w in words.T]], ["node_id", *bitmaps.WORD_NAMES])
    want = [(i, 64 * w + b) for i in range(40) for w in range(bitmaps.WORDS) for b in range(64) if int(words[i, w]) >> b & 1]
    assert list(zip(*(x.tolist() for x in bitmaps._set_bits(batch, 1)), strict=True)) == want


def test_few_starts_push_few_words(spark):
    edges = sorted(set(layered(6)))
    names, graph = graph_of(spark, edges)
    made = bitmaps.closure(graph, spark.createDataFrame([(n,) for n in names[:70]], "node_id string"), "forward")
    written = spark.read.parquet(made.reached.inputFiles()[0]).columns
    assert [c for c in written if c in bitmaps.WORD_NAMES] == ["w0", "w1"]
    assert {tuple(r) for r in made.pairs().collect()} == {(n, m) for n in names[:70] for m in beyond(edges, n)}


def test_many_pairs_are_swept_not_walked(spark, monkeypatch):
    edges = sorted(set(layered(7)))
    names, graph = graph_of(spark, edges)
    rng = random.Random(7)
    asked = {(rng.choice(names), rng.choice(names)) for _ in range(600)} | {("n0_1", "n0_1"), ("nobody", "n0_1"), ("n0_1", "nobody"), ("nobody", "nobody")}
    pairs = spark.createDataFrame([*asked, *list(asked)[:9]], "src string, dst string")

    def walked(*_):
        raise AssertionError("a row for each start and vertex")

    monkeypatch.setattr(reach, "walk", walked)
    for reflexive in (True, False):
        got = [tuple(r) for r in reach.can_reach(graph, pairs, reflexive).collect()]
        assert len(got) == len(asked)
        assert {(a, b): r for a, b, r in got} == {(a, b): (a == b and a in names and reflexive) or (a != b and b in beyond(edges, a)) for a, b in asked}
