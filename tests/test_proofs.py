"""Proofs of many targets, which keep their statements once, against those that are walked."""

from __future__ import annotations

import copy

import pytest
from pyspark.sql import functions as F
from test_integrity import edited

from heirline.operators import merkle, reach, report
from heirline.plans import bitmaps


@pytest.fixture
def graph(graphs, monkeypatch):
    monkeypatch.setattr(reach, "MANY_IDS", 1)
    return graphs("diamond")


def proofs_of(graph):
    return merkle.prove(graph, graph.nodes.select("node_id"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_swept_proofs_say_what_walked_ones_say(spark, graph, monkeypatch):
    found = proofs_of(graph)
    monkeypatch.setattr(reach, "MANY_IDS", 10**6)
    walked = proofs_of(graph)
    assert isinstance(found, merkle.SweptProof) and not isinstance(walked, merkle.SweptProof)
    for one, other in zip((*report.proof_report(walked), walked.entries, walked.links), (*report.proof_report(found), found.entries, found.links), strict=True):
        assert one.columns == other.columns and rows_of(one) == rows_of(other)
    changed = edited(spark, graph, graph.roots.first().node_id)
    gone = graph.nodes.filter(F.col("node_id") != graph.roots.first().node_id)
    for nodes, hub_parents in ((changed, 200_000), (gone, 1)):
        verdicts = rows_of(merkle.verify(found, nodes, hub_parents))
        assert verdicts == rows_of(merkle.verify(walked, nodes, hub_parents)) and any("TAMPER" in v for v in verdicts)


def test_forged_swept_proofs_fail(graph):
    proof = proofs_of(graph)
    at_b = F.col("node_id") == "b"

    def valid(**forged):
        fake = copy.copy(proof)
        fake.__dict__.update(forged)
        return {r.target: r.valid for r in merkle.verify(fake).collect()}

    assert valid() == dict.fromkeys("abcd", True)
    below = {"a": True, "b": False, "c": False, "d": False}
    assert valid(facts=proof.facts.withColumn("own", F.when(at_b, F.concat("own", F.lit("x=1;"))).otherwise(F.col("own")))) == below
    assert valid(facts=proof.facts.withColumn("hash", F.when(at_b, F.lit("0" * 64)).otherwise(F.col("hash")))) == below
    assert valid(facts=proof.facts.filter(~at_b)) == below
    assert valid(above=proof.above.filter("parent_id <> 'b'"))["d"] is False
    # An entry that a proof lacks is a hole in it, though the statement is there for others.
    held = proof.members.reached
    assert not any(valid(members=bitmaps.Closure(proof.members.starts, held.filter("node_id <> 'a'"))).values())


def test_proof_targets_of_many_write_no_pairs(graph):
    """Neither entries nor links are written for a question that needs their number alone."""
    places = []
    save = graph.scratch.save
    graph.scratch.save = lambda df, path, **options: places.append(path) or save(df, path, **options)
    try:
        assert report.proof_report(proofs_of(graph))[0].count() == graph.node_count
    finally:
        del graph.scratch.save
    assert places and not [p for p in places if "proof-entries" in p or "proof-links" in p or "proof-members" in p]
