"""Impact, lineage, paths and reports on the fixtures."""

from __future__ import annotations

from fixtures import FIXTURES, ids, pairs_of, seeds_of

from heirline.operators import impact, labels, paths, reach, report, risk


def found(df):
    return {r.node_id for r in df.collect()}


def test_k_hops(spark, graphs):
    graph = graphs("chain")
    assert found(impact.impacted(graph, ids(spark, "ds"), 1)) == {"m1"}
    assert found(impact.impacted(graph, ids(spark, "ds"), 2)) == {"m1", "m2"}
    assert found(impact.impacted(graph, ids(spark, "ds"), 3)) == {"m1", "m2", "p1"}
    assert found(impact.impacted(graph, ids(spark, "ds"), 0)) == set()
    assert found(impact.impacted(graph, ids(spark, "ds"), -1)) == set()
    assert found(impact.impacted(graph, ids(spark, "unknown"))) == set()
    assert found(impact.lineage(graph, ids(spark, "p1"))) == {"ds", "tool", "m1", "m2"}
    assert found(impact.lineage(graph, ids(spark, "p1"), 1)) == {"m2"}
    counts = {(r.k): r.impacted for r in reach.hop_counts(graph, ids(spark, "ds"), 3).collect()}
    assert counts == {1: 1, 2: 2, 3: 3}
    none = reach.hop_counts(graph, ids(spark, "p1"), 2).collect()
    assert [(r.k, r.impacted) for r in none] == [(1, 0), (2, 0)]


def test_hops_in_demo(spark, graphs):
    rows = impact.impacted(graphs("demo"), ids(spark, "ds_imagenet"), 9).collect()
    assert {r.node_id: r.hops for r in rows} == {
        "model_classifier_v1": 1, "model_clip": 1, "model_resnet50": 1, "model_vit_base": 1,
        "model_multimodal": 2, "prod_content_mod": 2, "prod_search": 2, "prod_vision_api": 2,
    }


def test_order_of_listings(spark, graphs):
    graph = graphs("demo")
    scores = risk.propagate(graph, ids(spark, "ds_imagenet"))
    rows = impact.impacted(graph, ids(spark, "ds_imagenet"), None, scores).collect()
    assert [r.risk for r in rows] == sorted((r.risk for r in rows), reverse=True)
    assert all(r.hops is None for r in rows)
    assert rows[0].content["name"] == "ImageClassifier-v1"
    flat = impact.impacted(graph, ids(spark, "ds_pile")).collect()
    kinds = [r.node_type for r in flat]
    assert kinds == sorted(kinds, key=["product", "model", "tool", "dataset"].index)
    assert [r.node_id for r in flat if r.node_type == "product"] == sorted(
        r.node_id for r in flat if r.node_type == "product"
    )


def test_batch_equals_single(spark, graphs):
    graph = graphs("demo")
    both = impact.impacted(graph, ids(spark, "ds_pile", "tool_rlhf"))
    for one in ("ds_pile", "tool_rlhf"):
        alone = found(impact.impacted(graph, ids(spark, one)))
        assert found(both.filter(f"query_id = '{one}'")) == alone


def test_paths(spark, graphs):
    graph = graphs("demo")
    asked = {
        ("ds_imagenet", "prod_content_mod"): 2,
        ("ds_pile", "prod_chatbot"): 3,
        ("ds_laion", "prod_vision_api"): 3,
        ("ds_commonvoice", "prod_transcription"): 2,
        ("ds_pile", "ds_pile"): 0,
    }
    nowhere = [("prod_chatbot", "ds_pile"), ("ds_commonvoice", "prod_content_mod"), ("ds_pile", "zz"), ("zz", "zz")]
    answers = {(r.src, r.dst): r for r in paths.shortest_paths(graph, pairs_of(spark, *asked, *nowhere)).collect()}
    for pair, hops in asked.items():
        row = answers[pair]
        assert row.reachable and row.hops == hops and len(row.path) == hops + 1
        assert (row.path[0], row.path[-1]) == pair
    for pair in nowhere:
        row = answers[pair]
        assert (row.reachable, row.path, row.hops) == (False, None, 0)


def test_broken_steps(spark, graphs):
    rows = spark.createDataFrame([("a", "d", ["a", "b", "d"])], "src string, dst string, path array<string>")
    bad = paths.broken_steps(rows, graphs("diamond").edges).collect()
    assert [(r.step, r["at"], r["next"]) for r in bad] == [(2, "b", "d")]


def test_reach_in_seven(spark, graphs):
    graph = graphs("seven")
    yes = [("ds1", "m1"), ("ds1", "p1"), ("sc1", "p1"), ("m1", "m1")]
    no = [("ds1", "p2"), ("ds2", "p1"), ("m1", "ds1"), ("p1", "ds1"), ("m1", "m2"), ("zz", "p1"), ("zz", "zz")]
    answers = {(r.src, r.dst): r.reachable for r in reach.can_reach(graph, pairs_of(spark, *yes, *no)).collect()}
    assert answers == {**{p: True for p in yes}, **{p: False for p in no}}
    strict = reach.can_reach(graph, pairs_of(spark, ("m1", "m1")), reflexive=False).first()
    assert not strict.reachable


def test_reach_query_shows_intervals(spark, graphs):
    graph = graphs("seven")
    marks = labels.interval_labels(graph)
    row = report.reach_query(graph, marks, pairs_of(spark, ("ds1", "p1"))).first()
    assert (row.reachable, row.src_disc, row.src_fin, row.dst_disc, row.dst_fin) == (True, 1, 6, 3, 4)
    lost = {r.node_id: (r.disc, r.fin, r.indexed) for r in labels.labels_of(marks, ids(spark, "zz", "m2")).collect()}
    assert lost == {"zz": (-1, -1, False), "m2": (8, 11, True)}
    inside = {(r.src, r.dst): r.contained for r in labels.contained(marks, pairs_of(spark, ("ds1", "p1"), ("p1", "ds1"), ("sc1", "m1"))).collect()}
    assert inside == {("ds1", "p1"): True, ("p1", "ds1"): False, ("sc1", "m1"): False}


def test_report(spark, graphs):
    graph = graphs("demo")
    scores = risk.propagate(graph, ids(spark, "ds_imagenet"))
    rows = {r.query_id: r for r in impact.impact_reports(graph, ids(spark, "model_clip", "ds_imagenet", "zz"), scores).collect()}
    top = rows["ds_imagenet"]
    assert (top.total_impacted, top.upstream_lineage, top.type_breakdown) == (8, 0, {"model": 5, "product": 3})
    assert top.poisoned_node.risk == 1.0 and top.poisoned_node.hash == FIXTURES["demo"].golden["ds_imagenet"][-1]
    assert [c.node_id for c in top.impacted_nodes][:2] == ["model_classifier_v1", "prod_vision_api"]
    clip = rows["model_clip"]
    assert (clip.total_impacted, clip.upstream_lineage) == (3, 3)
    assert [c.node_id for c in clip.ancestor_nodes] == ["ds_imagenet", "ds_laion", "tool_cliptrainer"]
    assert rows["zz"].error == "Node not found: zz" and rows["zz"].total_impacted is None
    bare = impact.impact_reports(graph, ids(spark, "tool_rlhf")).first()
    assert bare.poisoned_node.risk == 1.0


def test_report_limits(spark):
    from heirline import LineageGraph

    nodes = [("s", "dataset")] + [(f"m{i:03d}", "model") for i in range(50)]
    edges = [("s", f"m{i:03d}", i / 100) for i in range(50)]
    graph = LineageGraph(
        spark.createDataFrame(nodes, "node_id string, node_type string"),
        spark.createDataFrame(edges, "src string, dst string, weight double"),
    )
    scores = risk.propagate(graph, ids(spark, "s"))
    row = impact.impact_reports(graph, ids(spark, "s"), scores).first()
    assert row.total_impacted == 50
    assert [c.node_id for c in row.impacted_nodes] == [f"m{i:03d}" for i in range(49, 29, -1)]


def test_queries_of_answers(spark, graphs):
    graph = graphs("chain")
    scores = risk.propagate(graph, seeds_of(spark, FIXTURES["chain"]))
    head, rows = report.impact_query(graph, ids(spark, "ds"), 2, scores)
    assert [(r.source, r.k, r.total_impacted) for r in head.collect()] == [("ds", 2, 2)]
    assert [(r.node_id, r.hops) for r in rows.collect()] == [("m1", 1), ("m2", 2)]
    assert {r.node_id for r in report.ancestor_query(graph, ids(spark, "m1")).collect()} == {"ds", "tool"}
    levels = {r.node_id: r.risk_level for r in risk.risk_of(scores, ids(spark, "ds", "tool", "zz")).collect()}
    assert levels == {"ds": "CRITICAL", "tool": "SAFE", "zz": "SAFE"}
