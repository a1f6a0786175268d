"""Tampering, snapshots and proofs."""

from __future__ import annotations

import hashlib

import pytest
from fixtures import FIXTURES, ids, seeds_of
from pyspark.sql import functions as F

from heirline import LineageGraph
from heirline.operators import merkle, report
from heirline.sources import apply_edits

EDIT = "node_id string, key string, value string, seq long"


def edited(spark, graph, node_id, key="poisoned", value="true"):
    return apply_edits(graph.nodes, spark.createDataFrame([(node_id, key, value, 0)], EDIT))


def test_tampering_spreads_downstream_only(spark, graphs):
    graph = graphs("seven")
    after = merkle.hash_chain(graph, edited(spark, graph, "ds1"))
    states = {r.node_id: r.state for r in merkle.snapshot_diff(graph.hashes, after).collect()}
    assert {n for n, s in states.items() if s == "changed"} == {"ds1", "m1", "p1"}
    assert {n for n, s in states.items() if s == "unchanged"} == {"ds2", "sc1", "m2", "p2"}


def test_demo_tampering_changes_nine(spark, graphs):
    graph = graphs("demo")
    after = merkle.hash_chain(graph, edited(spark, graph, "ds_imagenet"))
    assert merkle.snapshot_diff(graph.hashes, after).filter("state = 'changed'").count() == 9


def test_snapshot_added_and_removed(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "node_id string, hash string")
    after = spark.createDataFrame([("b", "3"), ("c", "4")], "node_id string, hash string")
    states = {r.node_id: r.state for r in merkle.snapshot_diff(before, after).collect()}
    assert states == {"a": "removed", "b": "changed", "c": "added"}


def test_detect_tampering(spark, graphs):
    graph = graphs("facade")
    good = FIXTURES["facade"].golden["ds"][-1]
    expected = spark.createDataFrame(
        [("ds", good), ("t", "deadbeef000"), ("zz", "x"), ("m", None)], "node_id string, hash string"
    )
    found = {r.node_id: r.tampered for r in merkle.detect_tampering(graph.hashes, expected).collect()}
    assert found == {"ds": False, "t": True, "zz": False, "m": True}


@pytest.mark.parametrize("name", ["diamond", "demo"])
def test_proofs_hold_on_untouched_graph(spark, graphs, name):
    graph = graphs(name)
    proof = merkle.prove(graph, graph.nodes.select("node_id"))
    for hub_parents in (200_000, 1):
        verdicts = merkle.verify(proof, hub_parents=hub_parents).collect()
        assert len(verdicts) == graph.node_count and all(r.valid for r in verdicts)
    assert all(r.valid for r in merkle.verify(proof, graph.nodes).collect())


def test_proof_content(spark, graphs):
    proof = merkle.prove(graphs("diamond"), ids(spark, "c", "unknown"))
    targets, chain = report.proof_report(proof)
    assert [(r.target, r.target_hash, r.chain_length) for r in targets.collect()] == [
        ("c", FIXTURES["diamond"].golden["c"][-1], 3)
    ]
    assert {r.node_id: r.parents for r in chain.collect()} == {"a": [], "b": ["a"], "c": ["a", "b"]}


def test_forged_proofs_fail(spark, graphs):
    proof = merkle.prove(graphs("diamond"), ids(spark, "d"))
    at_b = F.col("node_id") == "b"

    def verdict(entries=None, links=None):
        return merkle.verify(merkle.Proof(entries or proof.entries, links or proof.links)).first()

    assert verdict().message == "Integrity confirmed"
    own = F.when(at_b, F.concat("own", F.lit("x=1;"))).otherwise(F.col("own"))
    assert verdict(proof.entries.withColumn("own", own)).message == "TAMPER DETECTED!"
    changed = F.when(at_b, F.lit("0" * 64)).otherwise(F.col("hash"))
    assert not verdict(proof.entries.withColumn("hash", changed)).valid
    assert not verdict(proof.entries.filter(~at_b)).valid
    assert not verdict(links=proof.links.filter("parent_id <> 'b'")).valid
    assert not verdict(entries=proof.entries.filter("node_id <> 'd'"), links=proof.links.filter("node_id <> 'd'")).valid


def test_proof_against_changed_catalog(spark, graphs):
    graph = graphs("demo")
    proof = merkle.prove(graph, ids(spark, "prod_chatbot", "prod_vision_api"))
    verdicts = report.proof_verdict(proof, edited(spark, graph, "ds_imagenet")).collect()
    assert {r.target: r.valid for r in verdicts} == {"prod_chatbot": True, "prod_vision_api": False}


def test_hub_hash_equals_plain(spark):
    """One vertex with 3,000 parents hashed in a row and as a stream of chunks."""
    parents = [(f"d{i:04d}", "dataset", {"i": str(i)}, "unknown") for i in range(3000)]
    nodes = spark.createDataFrame(
        [*parents, ("hub", "model", {}, "unknown"), ("top", "product", {}, "unknown")],
        "node_id string, node_type string, content map<string,string>, creator string",
    )
    edges = spark.createDataFrame(
        [*[(p[0], "hub", 0.001) for p in parents], ("hub", "top", 0.5)], "src string, dst string, weight double"
    )
    plain = LineageGraph(nodes, edges)
    split = LineageGraph(nodes, edges, hot_degree=500)
    assert split.hot_targets.first().parts == 6
    diff = merkle.snapshot_diff(plain.hashes, split.hashes)
    assert {r.state for r in diff.select("state").distinct().collect()} == {"unchanged"}

    def lists(graph, **options):
        return sorted((r.node_id, r.part, r.parents) for r in merkle.parent_lists(graph, **options).collect())

    # The rows depend on the ids alone, not on how a hub is spread.
    assert lists(split) == lists(plain)
    parts = [p for n, _, p in lists(split, size=700) if n == "hub"]
    assert [len(p) for p in parts] == [700, 700, 700, 700, 200] and sum(parts, []) == [p[0] for p in parents]


def test_hub_chunks_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HUB_CHUNK", 7)
    own = spark.createDataFrame([("a", "x;"), ("b", "y;")], "node_id string, own string")
    rows = [(n, f"{i * 7919 % 1000:064d}") for n in ("a", "b") for i in range(100)]
    parents = spark.createDataFrame(rows, "node_id string, parent_hash string")
    streamed = {r.node_id: r.hash for r in merkle.hub_hashes(own, parents, 200).collect()}
    plain = {r.node_id: r.hash for r in merkle.hash_from_parents(own, parents, None).collect()}
    assert streamed == plain


def test_compromise_and_stats(spark, graphs):
    graph = graphs("facade")
    scores, summary, best = report.compromise(graph, seeds_of(spark, FIXTURES["facade"]))
    assert summary.first().total_nodes == 4
    assert [r.node_id for r in best.collect()] == ["ds", "m", "p", "t"]
    row = report.graph_stats(graph, scores, ids(spark, "ds")).first()
    assert (row.total_nodes, row.total_edges, row.root_nodes, row.leaf_nodes, row.compromised_nodes) == (4, 3, 2, 1, 1)
    built = report.build_summary(graph).first()
    assert (built.nodes, built.edges, built.layers, built.hashed) == (4, 3, 3, 4)
    assert {r.node_id for r in graph.roots.collect()} == {"ds", "t"}
    assert {r.node_id for r in graph.leaves.collect()} == {"p"}
    listing = {r.node_id: r.parents for r in report.hash_listing(graph).collect()}
    assert listing == {"ds": [], "t": [], "m": ["ds", "t"], "p": ["m"]}


@pytest.mark.parametrize("options", [{}, {"hot_degree": 2}])
def test_hashes_and_lists_need_no_table_by_target(spark, options):
    graph, told = (LineageGraph(*FIXTURES["seven"].frames(spark), **options) for _ in range(2))
    _ = told.backward
    sides = [{r.node_id: r.hash for r in g.hashes.collect()} for g in (graph, told)]
    lists = [sorted((r.node_id, r.part, *r.parents) for r in merkle.parent_lists(g).collect()) for g in (graph, told)]
    assert sides[0] == sides[1] and lists[0] == lists[1]
    assert "backward" not in graph.__dict__


def test_hashes_as_bytes_give_the_same_digests(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)]
    links = [(f"n{i % 5}", d) for i, d in enumerate(digests)] + [("n1", digests[1])]
    own = spark.createDataFrame([(f"n{i}", f"own {i};") for i in range(6)], "node_id string, own string")
    parents = spark.createDataFrame(links, "node_id string, parent_hash string")
    hubs = spark.createDataFrame([("n1",)], "node_id string")
    want = {f"n{i}": hashlib.sha256((f"own {i};" + "".join(f"parent={d};" for d in sorted(d for n, d in links if n == f"n{i}"))).encode()).hexdigest() for i in range(6)}
    packed = parents.withColumn("parent_hash", F.unhex("parent_hash"))
    for given in (parents, packed):
        for several in (None, hubs):
            assert {r.node_id: r.hash for r in merkle.hash_from_parents(own, given, several).collect()} == want
