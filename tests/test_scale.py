"""What is written on the way: levels and listings must not grow with pairs where ids or blocks are enough."""

from __future__ import annotations

from collections import defaultdict

import pytest
from fixtures import pairs_of

from heirline import LineageGraph
from heirline.operators import impact, merkle, paths, reach, risk
from heirline.plans import bitmaps
from heirline.plans.scratch import Scratch


@pytest.fixture
def written(monkeypatch):
    """Rows written, by the name of the place."""
    rows, plain = defaultdict(list), Scratch.save

    def save(self, df, path, **options):
        stored = plain(self, df, path, **options)
        rows[path[len(self.path) + 6 :].split("/")[0]].append(stored.rows)
        return stored

    monkeypatch.setattr(Scratch, "save", save)
    return rows


def graph_of(spark, names, edges, **options):
    nodes = spark.createDataFrame([(n, "model") for n in names], "node_id string, node_type string")
    return LineageGraph(nodes, spark.createDataFrame([(a, b, 0.5) for a, b in edges], "src string, dst string, weight double"), **options)


def test_a_path_level_belongs_to_an_end_not_to_a_pair(spark, written):
    """One source with many children is asked for many targets: its children are walked once, not for each target."""
    middle, targets = [f"m{i:02d}" for i in range(60)], [f"t{i:02d}" for i in range(40)]
    edges = [("s", m) for m in middle] + [(middle[i], t) for i, t in enumerate(targets)] + [(middle[i + 1], t) for i, t in enumerate(targets)]
    graph = graph_of(spark, ["s", "alone", *middle, *targets], edges)
    asked = [("s", t) for t in targets] + [("alone", targets[0]), ("s", "zz")]
    found = {(r.src, r.dst): r.path for r in paths.shortest_paths(graph, pairs_of(spark, *asked)).collect()}
    assert found == {**{("s", t): ["s", middle[i], t] for i, t in enumerate(targets)}, ("alone", targets[0]): None, ("s", "zz"): None}
    assert max(written["path-forward"] + written["path-backward"]) <= 2 * len(targets)


@pytest.fixture
def layered(spark):
    """130 sources over 40 middles and 30 ends, and a vertex alone."""
    sources, middle, ends = [f"s{i:03d}" for i in range(130)], [f"m{i:02d}" for i in range(40)], [f"e{i:02d}" for i in range(30)]
    edges = {(s, middle[i * k % 40]) for i, s in enumerate(sources) for k in (1, 7)} | {(m, ends[i * k % 30]) for i, m in enumerate(middle) for k in (1, 3)}
    return graph_of(spark, ["alone", *sources, *middle, *ends], sorted(edges))


@pytest.mark.parametrize("operator", [impact.impacted, impact.lineage])
def test_listings_of_many_ids_do_not_shuffle_their_pairs(layered, monkeypatch, operator):
    ids = layered.nodes.select("node_id")
    scores = risk.propagate(layered, ids.filter("node_id < 'm'"))
    monkeypatch.setattr(bitmaps, "TASK_PAIRS", 300)
    found = operator(layered, ids, None, scores)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [line for line in plan if "Exchange" in line or "Generate" in line][0].count("getbit")
    assert found.rdd.getNumPartitions() > 1
    swept = found.collect()
    monkeypatch.setattr(reach, "MANY_IDS", 10**6)
    walked = operator(layered, ids, None, scores).collect()
    assert swept == walked and len({r.query_id for r in swept}) > 64


def test_proofs_of_many_ids_are_swept(layered, written, monkeypatch):
    ids = layered.nodes.select("node_id")

    def rows():
        proof = merkle.prove(layered, ids)
        assert all(r.valid for r in merkle.verify(proof).collect())
        return [sorted(tuple(r) for r in df.collect()) for df in (proof.entries, proof.links)]

    swept = rows()
    assert not written["walk-backward"]
    monkeypatch.setattr(reach, "MANY_IDS", 10**6)
    assert rows() == swept and written["walk-backward"]
