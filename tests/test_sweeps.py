"""What sweeps write, and payloads of parents in either form."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_bitmaps import beyond, graph_of

from heirline.functions.scalar import parent_payload
from heirline.operators import refresh
from heirline.plans import bitmaps
from heirline.plans.scratch import Scratch


@pytest.fixture
def places(monkeypatch):
    """The names of the places written."""
    names, plain = defaultdict(int), Scratch.save

    def save(self, df, path, **options):
        names[path[len(self.path) + 6 :].split("/")[0]] += 1
        return plain(self, df, path, **options)

    monkeypatch.setattr(Scratch, "save", save)
    return names


@pytest.mark.parametrize("options", [{}, {"hot_degree": 2}])
def test_rows_from_one_layer_are_not_written_twice(spark, places, options):
    """Layers that hear from one layer, from two, and that hold starts of their own; only what comes from two is merged once more."""
    edges = [(f"a{i}", f"b{i % 3}") for i in range(6)] + [(f"b{i}", f"c{i % 2}") for i in range(3)]
    names, graph = graph_of(spark, edges, **options)
    asked = graph.nodes.select("node_id").filter("node_id < 'c'")
    made = bitmaps.closure(graph, asked, "forward")
    assert not places["push-forward-done"]
    got = [tuple(r) for r in made.pairs().collect()]
    assert sorted(got) == sorted((n, m) for n in names if n < "c" for m in beyond(edges, n))
    edges += [("a0", "c1"), ("c1", "d"), ("a1", "d"), ("c0", "d")]
    names, graph = graph_of(spark, edges, **options)
    got = [tuple(r) for r in bitmaps.closure(graph, graph.nodes.select("node_id"), "forward").pairs().collect()]
    assert places["push-forward-done"] == 2
    assert sorted(got) == sorted((n, m) for n in names for m in beyond(edges, n))


def test_a_refresh_needs_no_pushed_edges(spark, places):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")]
    _, graph = graph_of(spark, edges)
    nodes = graph.nodes.withColumn("content", F.when(F.col("node_id") == "a", F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.col("content")))
    made = refresh.refreshed_hashes(graph, nodes, refresh.bucketed_hashes(graph, graph.hashes))
    assert (made.recomputed, made.changed) == (3, 3)
    assert not places["pushed-forward"] and not places["touched"]


def test_payload_of_bytes_and_of_digits(spark):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    row = spark.createDataFrame([(hashes,)], "h array<string>")
    packed = F.transform("h", F.unhex)
    texts = row.select(parent_payload(F.col("h")).alias("a"), parent_payload(packed, True).alias("b"), parent_payload(F.array().cast("array<binary>"), True).alias("c")).first()
    assert texts.a == texts.b == "".join(f"parent={h};" for h in sorted(hashes)) and texts.c == ""
