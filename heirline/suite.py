"""Named queries over a folder of star-schema tables.

Each takes a session and the folder and returns a DataFrame. The prepared catalog is
kept per session and folder, as a user would keep it between questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.functions.scalar import content_of, content_text, risk_level
from heirline.graph import LineageGraph
from heirline.operators import cycles, impact, labels, lookup, merkle, paths, reach, reachindex, refresh, report, risk, topo
from heirline.sources import ingest
from heirline.sources.catalog import catalog_edges, catalog_nodes, catalog_seeds, node_key, part_blocks, table
from heirline.sources.synthetic import synthetic_dag

PLACES = 6
# Added before rounding a risk: two-digit weights often give exact halves, which the
# order of the factors would otherwise push to either side.
NUDGE = 1e-9
SUPPLIER = "supplier_7"


class Workspace:
    """The catalog of one folder and what is computed once for it."""

    _open: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Workspace:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def graph(self) -> LineageGraph:
        spark, folder = self.spark, self.folder
        return self.once(
            "graph", lambda: LineageGraph(catalog_nodes(spark, folder), catalog_edges(spark, folder), unique=True)
        )

    @property
    def blocks(self) -> LineageGraph:
        return self.once("blocks", lambda: LineageGraph(*part_blocks(self.spark, self.folder), unique=True))

    @property
    def seeds(self) -> DataFrame:
        return catalog_seeds(self.spark, self.folder)

    @property
    def scores(self) -> DataFrame:
        return self.once("scores", lambda: risk.propagate(self.graph, self.seeds))

    @property
    def even_scores(self) -> DataFrame:
        """Scores rounded, so that equal ones rank alike whatever the order of factors."""
        return self.scores.withColumn("risk", shown(F.col("risk")))

    @property
    def labels(self) -> DataFrame:
        return self.once("labels", lambda: labels.interval_labels(self.graph))

    @property
    def index(self) -> reachindex.ReachIndex | None:
        return self.once("index", lambda: reachindex.reach_index(self.graph, self.labels))

    @property
    def poisoned(self) -> DataFrame:
        """The artifacts after someone has edited every seed."""
        edits = self.seeds.select(
            "node_id", F.lit("poisoned").alias("key"), F.lit("true").alias("value"), F.lit(0).alias("seq")
        )
        return ingest.apply_edits(self.graph.nodes, edits)

    @property
    def poisoned_hashes(self) -> DataFrame:
        return self.once("poisoned_hashes", lambda: merkle.hash_chain(self.graph, self.poisoned))

    def first_customers(self) -> DataFrame:
        """(node_id) of the first customer of every nation."""
        first = self.table("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
        return first.select(node_key("customer", "c").alias("node_id"))

    def all_of(self, name: str, prefix: str, key: str) -> DataFrame:
        return self.table(name).select(node_key(prefix, key).alias("node_id"))

    def home_pairs(self) -> DataFrame:
        """(src, dst): every customer with its nation, in both directions."""
        c = self.table("customer")
        nation, customer = node_key("nation", "c_nationkey"), node_key("customer", "c_custkey")
        return c.select(nation.alias("src"), customer.alias("dst")).unionByName(
            c.select(customer.alias("src"), nation.alias("dst"))
        )

    def block_pairs(self) -> DataFrame:
        """(src, dst): every part with the first part of its block, and back."""
        p = self.table("part").select(
            node_key("part", "p_partkey").alias("dst"),
            F.concat(F.lit("part_"), (F.floor(F.col("p_partkey") / 16) * 16).cast("string")).alias("src"),
        )
        back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return p.unionByName(back).distinct()


def shown(risk: Column) -> Column:
    """A risk as the queries show it."""
    return F.round(risk + NUDGE, PLACES)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def listing(df: DataFrame, column: str) -> DataFrame:
    """Ids of an array column as one text."""
    return df.withColumn(column, F.concat_ws(">", column))


def catalog_nodes_query(w: Workspace) -> DataFrame:
    return w.graph.nodes.select("node_id", "node_type", "creator", content_text(F.col("content")).alias("content"))


def catalog_edges_query(w: Workspace) -> DataFrame:
    return rounded(w.graph.edges.select("src", "dst", "weight"), "weight")


def latest_artifacts(w: Workspace) -> DataFrame:
    """Every event re-ingests its user; the last one counts."""
    rows = w.table("events").select(
        node_key("user", "user_id").alias("node_id"),
        F.lit("tool").alias("node_type"),
        content_of(origin="events").alias("fixed"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("kind"),
        F.col("event_id").alias("seq"),
    )
    whole = rows.withColumn("content", F.map_concat("fixed", "kind")).drop("fixed", "kind")
    return ingest.clean_nodes(whole).select(
        "node_id", "node_type", "creator", content_text(F.col("content")).alias("content"), "seq"
    )


def latest_edges(w: Workspace) -> DataFrame:
    """Every event rewrites the edge from its user to its kind; weights are clamped."""
    rows = w.table("events").select(
        node_key("user", "user_id").alias("src"),
        F.concat(F.lit("kind_"), "event_type").alias("dst"),
        (F.col("value") / 50).alias("weight"),
        F.col("event_id").alias("seq"),
    )
    return rounded(ingest.clean_edges(rows).select("src", "dst", "weight", "seq"), "weight")


def content_edits(w: Workspace) -> DataFrame:
    return w.poisoned.select("node_id", content_text(F.col("content")).alias("content"))


def node_lookup(w: Workspace) -> DataFrame:
    return lookup.lookup(w.graph.nodes, w.seeds).select("node_id", "node_type", F.col("content")["name"].alias("name"))


def node_children(w: Workspace) -> DataFrame:
    return rounded(lookup.children(w.graph, w.seeds), "weight")


def node_parents(w: Workspace) -> DataFrame:
    return rounded(lookup.parents(w.graph, w.first_customers()), "weight")


def parent_lists(w: Workspace) -> DataFrame:
    sized = merkle.parent_lists(w.graph).withColumn("n", F.size("parents").cast("long"))
    return listing(sized.select("node_id", F.col("part").cast("long").alias("part"), "parents", "n"), "parents")


def known_ids(w: Workspace) -> DataFrame:
    """Which customer numbers are supplier numbers too."""
    return lookup.exists(w.graph.nodes, w.all_of("customer", "supplier", "c_custkey"))


def edge_weights(w: Workspace) -> DataFrame:
    """Every edge looked up in its own and in the opposite direction."""
    e = w.graph.edges
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rounded(lookup.edge_weights(e, e.select("src", "dst").unionByName(back)), "weight")


def degrees(w: Workspace) -> DataFrame:
    return w.graph.degrees.df.select("node_id", "in_degree", "out_degree")


def graph_stats(w: Workspace) -> DataFrame:
    row = report.graph_stats(w.graph, w.scores, w.seeds)
    levels = [F.col("level_counts")[n].alias(n.lower()) for n in risk.LEVEL_NAMES]
    row = row.withColumns({c: shown(F.col(c)) for c in ("max_risk", "min_risk")})
    return row.select(*[c for c in row.columns if c != "level_counts"], *levels)


def build_summary(w: Workspace) -> DataFrame:
    return report.build_summary(w.graph).withColumn("layers", F.col("layers").cast("long"))


def invalid_edges(w: Workspace) -> DataFrame:
    """The catalog plus an edge from every customer to the tenth nation after its own."""
    wrong = w.table("customer").select(
        node_key("customer", "c_custkey").alias("src"),
        F.concat(F.lit("nation_"), (F.col("c_nationkey") + 10).cast("string")).alias("dst"),
        F.lit(0.9).alias("weight"),
    )
    edges = w.graph.edges.select("src", "dst", "weight").unionByName(wrong)
    return ingest.invalid_edges(edges, w.graph.nodes)


def missing_seeds(w: Workspace) -> DataFrame:
    return ingest.missing_seeds(w.all_of("customer", "supplier", "c_custkey"), w.graph.nodes)


def topo_layers(w: Workspace) -> DataFrame:
    return w.graph.layers.select("node_id", F.col("layer").cast("long").alias("layer"))


def topo_order(w: Workspace) -> DataFrame:
    return topo.topological_order(w.graph).withColumn("layer", F.col("layer").cast("long"))


def block_layers(w: Workspace) -> DataFrame:
    return w.blocks.layers.select("node_id", F.col("layer").cast("long").alias("layer"))


def cycle_nodes(w: Workspace) -> DataFrame:
    """Returned full lots lead from the order back to the part."""
    back = (
        w.table("lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50))
        .select(node_key("order", "l_orderkey").alias("src"), node_key("part", "l_partkey").alias("dst"))
        .distinct()
        .withColumn("weight", F.lit(0.9))
    )
    edges = w.graph.edges.select("src", "dst", "weight").unionByName(back)
    return topo.cycle_nodes(LineageGraph(w.graph.nodes, edges, unique=True))


def merkle_hashes(w: Workspace) -> DataFrame:
    return w.graph.hashes.select("node_id", "hash")


def _refreshed(w: Workspace) -> refresh.Refreshed:
    old = w.once("bucketed_hashes", lambda: refresh.bucketed_hashes(w.graph, w.graph.hashes))
    return w.once("refreshed", lambda: refresh.refreshed_hashes(w.graph, w.poisoned, old))


def refreshed_hashes(w: Workspace) -> DataFrame:
    """The hashes of the poisoned catalog, made from the trusted ones."""
    return _refreshed(w).hashes


def refresh_report(w: Workspace) -> DataFrame:
    """How many artifacts ``refreshed_hashes`` hashed again, and how many of these changed."""
    found = _refreshed(w)
    return w.spark.createDataFrame([(found.recomputed, found.changed)], "recomputed long, changed long")


def hash_listing(w: Workspace) -> DataFrame:
    return listing(report.hash_listing(w.graph).withColumn("part", F.col("part").cast("long")), "parents")


def tamper_check(w: Workspace) -> DataFrame:
    """The trusted hashes against those of the poisoned catalog."""
    trusted = w.graph.hashes.select("node_id", "hash")
    return merkle.detect_tampering(w.poisoned_hashes, trusted)


def hash_diff(w: Workspace) -> DataFrame:
    return merkle.snapshot_diff(w.graph.hashes, w.poisoned_hashes).select("node_id", "state")


def _proof(w: Workspace) -> merkle.Proof:
    return w.once("proof", lambda: merkle.prove(w.graph, w.first_customers()))


def proof_targets(w: Workspace) -> DataFrame:
    return report.proof_report(_proof(w))[0]


def proof_rows(w: Workspace) -> DataFrame:
    return listing(report.proof_report(_proof(w))[1].withColumn("part", F.col("part").cast("long")), "parents")


def proof_verdict(w: Workspace) -> DataFrame:
    """Are the proofs still good for the poisoned catalog."""
    return report.proof_verdict(_proof(w), w.poisoned)


def risk_scores(w: Workspace) -> DataFrame:
    return w.scores.select("node_id", shown(F.col("risk")).alias("risk"), risk_level(F.col("risk")).alias("risk_level"))


def risk_levels(w: Workspace) -> DataFrame:
    return risk.level_counts(w.scores)


def risk_summary(w: Workspace) -> DataFrame:
    row = risk.risk_summary(w.scores)
    levels = [F.col("level_counts")[n].alias(n.lower()) for n in risk.LEVEL_NAMES]
    ends = [shown(F.col(c)).alias(c) for c in ("max_risk", "min_risk")]
    return row.select("total_nodes", "mean_risk", *ends, *levels)


def risk_topk(w: Workspace) -> DataFrame:
    return risk.top_risks(w.even_scores, 20)


def risk_of_customers(w: Workspace) -> DataFrame:
    return risk.risk_of(w.even_scores, w.all_of("customer", "customer", "c_custkey"))


def diffuse_rounds(w: Workspace) -> DataFrame:
    """Two damped rounds from the bare seeds."""
    start = w.seeds.select("node_id", F.col("probability").alias("risk"))
    return risk.diffuse(w.graph, start, rounds=2)[0].withColumn("risk", shown(F.col("risk")))


def diffusion_stop(w: Workspace) -> DataFrame:
    """Damped rounds from the bare seeds until nothing changes: how many, and what came out."""
    start = w.seeds.select("node_id", F.col("probability").alias("risk"))
    found = risk.diffusion(w.graph, start)
    return found.scores.agg(F.round(F.sum("risk"), 3).alias("total_risk")).select(
        F.lit(found.rounds).cast("long").alias("rounds"),
        F.lit(found.converged).alias("converged"),
        F.lit(round(found.change, 6)).alias("change"),
        "total_risk",
    )


def risk_ranking(w: Workspace) -> DataFrame:
    return risk.ranked(w.even_scores)


def compromise_answer(w: Workspace) -> DataFrame:
    """The summary and the ids of the highest risks, as one answer."""
    summary = risk.risk_summary(w.scores)
    # Five rows and one row.
    best = risk.top_risks(w.even_scores, 5).agg(F.array_sort(F.collect_list(F.struct((-F.col("risk")).alias("r"), "node_id"))).alias("b"))
    highest = best.select(F.concat_ws(">", F.transform("b", lambda x: x["node_id"])).alias("highest"))
    levels = [F.col("level_counts")[n].alias(n.lower()) for n in risk.LEVEL_NAMES]
    ends = [shown(F.col(c)).alias(c) for c in ("max_risk", "min_risk")]
    return summary.select("total_nodes", "mean_risk", *ends, *levels).join(highest, how="left")


def root_nodes(w: Workspace) -> DataFrame:
    return w.graph.roots


def leaf_nodes(w: Workspace) -> DataFrame:
    return w.graph.leaves


def seed_nodes(w: Workspace) -> DataFrame:
    return ingest.clean_seeds(w.seeds)


def invalid_nodes(w: Workspace) -> DataFrame:
    """Customers offered as artifacts of their market segment."""
    offered = w.table("customer").select(
        node_key("customer", "c_custkey").alias("node_id"), F.lower("c_mktsegment").alias("node_type")
    )
    return ingest.invalid_nodes(offered)


def extended_catalog(w: Workspace) -> DataFrame:
    """The edges after a further batch: from a part to every order, some of them known with another weight."""
    parts = w.table("part").count()
    drawn = w.table("orders").select("o_orderkey", (F.col("o_orderkey") % parts).alias("p_partkey"))
    batch = drawn.join(w.table("part").select("p_partkey"), "p_partkey").select(
        node_key("part", "p_partkey").alias("src"), node_key("order", "o_orderkey").alias("dst"), F.lit(0.25).alias("weight")
    )
    further = w.once("extended", lambda: w.graph.extended(edges=batch))
    return rounded(further.edges.select("src", "dst", "weight"), "weight")


def path_check(w: Workspace) -> DataFrame:
    """Claimed ways from every supplier over a part to the order after the one it was used for."""
    claimed = w.table("lineitem").select(
        node_key("supplier", "l_suppkey").alias("src"),
        node_key("part", "l_partkey").alias("mid"),
        F.concat(F.lit("order_"), (F.col("l_orderkey") + 1).cast("string")).alias("dst"),
    )
    trails = claimed.select("src", "dst", F.array("src", "mid", "dst").alias("path")).distinct()
    return paths.broken_steps(trails, w.graph.edges).withColumn("step", F.col("step").cast("long"))


IMPACT = ["query_id", "node_id", "node_type", "risk", "risk_level", "hops"]


def impacted_k(w: Workspace) -> DataFrame:
    return impact.impacted(w.graph, w.seeds, 2, w.even_scores).select(*IMPACT)


def impacted_all(w: Workspace) -> DataFrame:
    ids = w.all_of("supplier", "supplier", "s_suppkey").filter(F.col("node_id") == SUPPLIER)
    return impact.impacted(w.graph, ids, None, w.even_scores).select(*IMPACT)


def ancestors_k(w: Workspace) -> DataFrame:
    ids = w.all_of("customer", "customer", "c_custkey")
    return impact.lineage(w.graph, ids, 2, w.even_scores).select(*IMPACT)


def ancestors_all(w: Workspace) -> DataFrame:
    return impact.lineage(w.graph, w.first_customers(), None, w.even_scores).select(*IMPACT)


def impact_query(w: Workspace) -> DataFrame:
    head, _ = report.impact_query(w.graph, w.seeds, 2, w.even_scores)
    return head.withColumn("k", F.col("k").cast("long"))


def khop_sweep(w: Workspace) -> DataFrame:
    return reach.hop_counts(w.graph, w.seeds, 3).withColumn("k", F.col("k").cast("long"))


def can_reach_pairs(w: Workspace) -> DataFrame:
    return reach.can_reach(w.graph, w.home_pairs())


def _decided(w: Workspace) -> DataFrame:
    return reachindex.decide(w.graph, w.index, w.home_pairs())


def indexed_reach(w: Workspace) -> DataFrame:
    """The pairs of ``can_reach_pairs``, answered by the index."""
    return _decided(w).select("src", "dst", "reachable")


def reach_report(w: Workspace) -> DataFrame:
    return report.reach_query(w.graph, w.labels, w.home_pairs(), w.index)


def shortest_paths(w: Workspace) -> DataFrame:
    found = paths.shortest_paths(w.blocks, w.block_pairs())
    text = F.coalesce(F.concat_ws(">", "path"), F.lit(""))
    return found.withColumn("path", text).withColumn("hops", F.col("hops").cast("long"))


def catalog_paths(w: Workspace) -> DataFrame:
    """From every nation to the first customer of each."""
    ends = w.table("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
    pairs = ends.select(node_key("nation", "c_nationkey").alias("src"), node_key("customer", "c").alias("dst"))
    found = paths.shortest_paths(w.graph, pairs)
    text = F.coalesce(F.concat_ws(">", "path"), F.lit(""))
    return found.withColumn("path", text).withColumn("hops", F.col("hops").cast("long"))


def impact_report(w: Workspace) -> DataFrame:
    rows = impact.impact_reports(w.graph, w.seeds, w.even_scores)

    def ids(column: str):
        return F.concat_ws(">", F.transform(F.col(column), lambda c: c["node_id"]))

    counts = [F.coalesce(F.col("type_breakdown")[t], F.lit(0)).alias(f"{t}s") for t in ("product", "model", "tool", "dataset")]
    return rows.select(
        "query_id",
        F.col("poisoned_node.node_type").alias("node_type"),
        F.col("poisoned_node.risk").alias("risk"),
        F.col("poisoned_node.hash").alias("hash"),
        "total_impacted",
        *counts,
        "upstream_lineage",
        ids("impacted_nodes").alias("impacted_nodes"),
        ids("ancestor_nodes").alias("ancestor_nodes"),
    )


def interval_labels(w: Workspace) -> DataFrame:
    """Nested-set labels of the forest in which every artifact keeps its least parent; not numbers in the order of a search."""
    return w.labels


def interval_members(w: Workspace) -> DataFrame:
    return labels.enclosed(w.labels, w.all_of("nation", "nation", "n_nationkey"))


def _synthetic(w: Workspace) -> tuple[DataFrame, DataFrame]:
    numbers = w.table("part").select(F.col("p_partkey").alias("i"))
    size = numbers.count()
    return synthetic_dag(numbers, size, 2 * size)


def _chain(w: Workspace) -> LineageGraph:
    return w.once("chain", lambda: LineageGraph(*_synthetic(w), unique=True))


def synthetic_layers(w: Workspace) -> DataFrame:
    """Layers of a graph as deep as it has vertices."""
    return _chain(w).layers.select("node_id", F.col("layer").cast("long").alias("layer"))


def synthetic_nodes(w: Workspace) -> DataFrame:
    nodes, _ = _synthetic(w)
    return nodes.withColumn("content", content_text(F.col("content")))


def synthetic_edges(w: Workspace) -> DataFrame:
    return rounded(_synthetic(w)[1], "weight")


QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {
    "catalog_nodes": catalog_nodes_query,
    "catalog_edges": catalog_edges_query,
    "latest_artifacts": latest_artifacts,
    "latest_edges": latest_edges,
    "content_edits": content_edits,
    "node_lookup": node_lookup,
    "node_children": node_children,
    "node_parents": node_parents,
    "parent_lists": parent_lists,
    "known_ids": known_ids,
    "edge_weights": edge_weights,
    "degrees": degrees,
    "graph_stats": graph_stats,
    "build_summary": build_summary,
    "invalid_edges": invalid_edges,
    "missing_seeds": missing_seeds,
    "topo_layers": topo_layers,
    "topo_order": topo_order,
    "block_layers": block_layers,
    "cycle_nodes": cycle_nodes,
    "merkle_hashes": merkle_hashes,
    "refreshed_hashes": refreshed_hashes,
    "refresh_report": refresh_report,
    "hash_listing": hash_listing,
    "tamper_check": tamper_check,
    "hash_diff": hash_diff,
    "proof_targets": proof_targets,
    "proof_rows": proof_rows,
    "proof_verdict": proof_verdict,
    "risk_scores": risk_scores,
    "risk_levels": risk_levels,
    "risk_summary": risk_summary,
    "risk_topk": risk_topk,
    "risk_of_customers": risk_of_customers,
    "diffuse_rounds": diffuse_rounds,
    "impacted_k": impacted_k,
    "impacted_all": impacted_all,
    "ancestors_k": ancestors_k,
    "ancestors_all": ancestors_all,
    "impact_query": impact_query,
    "khop_sweep": khop_sweep,
    "can_reach_pairs": can_reach_pairs,
    "indexed_reach": indexed_reach,
    "reach_report": reach_report,
    "shortest_paths": shortest_paths,
    "catalog_paths": catalog_paths,
    "impact_report": impact_report,
    "interval_labels": interval_labels,
    "interval_members": interval_members,
    "synthetic_nodes": synthetic_nodes,
    "synthetic_edges": synthetic_edges,
    "synthetic_layers": synthetic_layers,
    "root_nodes": root_nodes,
    "leaf_nodes": leaf_nodes,
    "seed_nodes": seed_nodes,
    "invalid_nodes": invalid_nodes,
    "risk_ranking": risk_ranking,
    "compromise_answer": compromise_answer,
    "extended_catalog": extended_catalog,
    "path_check": path_check,
    "diffusion_stop": diffusion_stop,
}


def every_parent(w: Workspace) -> DataFrame:
    """The parents of all customers."""
    return rounded(lookup.parents(w.graph, w.all_of("customer", "customer", "c_custkey")), "weight")


def _returned(w: Workspace) -> LineageGraph:
    """The catalog in which all returned lots lead from the order back to the part."""
    back = (
        w.table("lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(node_key("order", "l_orderkey").alias("src"), node_key("part", "l_partkey").alias("dst"))
        .distinct()
        .withColumn("weight", F.lit(0.9))
    )
    edges = w.graph.edges.select("src", "dst", "weight").unionByName(back)
    return w.once("returned", lambda: LineageGraph(w.graph.nodes, edges, unique=True))


def every_cycle_node(w: Workspace) -> DataFrame:
    """All returned lots lead from the order back to the part."""
    return topo.cycle_nodes(_returned(w))


def every_cycle_member(w: Workspace) -> DataFrame:
    """Only what lies on a cycle of returned lots, with the least id and the size of its component."""
    return cycles.cycle_members(_returned(w))


def witness_cycles(w: Workspace) -> DataFrame:
    """One cycle of each component, as a text."""
    rows = cycles.witness_cycles(_returned(w)).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("position", "node_id"))).alias("way"))
    way = F.concat_ws(">", F.transform("way", lambda c: c["node_id"]))
    return rows.select("component", F.size("way").cast("long").alias("length"), way.alias("cycle"))


def _every_proof(w: Workspace) -> merkle.Proof:
    return w.once("every_proof", lambda: merkle.prove(w.graph, w.all_of("customer", "customer", "c_custkey")))


def every_proof_target(w: Workspace) -> DataFrame:
    return report.proof_report(_every_proof(w))[0]


def every_proof_row(w: Workspace) -> DataFrame:
    return listing(report.proof_report(_every_proof(w))[1].withColumn("part", F.col("part").cast("long")), "parents")


def every_proof_verdict(w: Workspace) -> DataFrame:
    return report.proof_verdict(_every_proof(w), w.poisoned)


def every_impact(w: Workspace) -> DataFrame:
    """Everything downstream of all suppliers."""
    ids = w.all_of("supplier", "supplier", "s_suppkey")
    return impact.impacted(w.graph, ids, None, w.even_scores).select(*IMPACT)


def every_ancestor(w: Workspace) -> DataFrame:
    """Everything upstream of all customers."""
    ids = w.all_of("customer", "customer", "c_custkey")
    return impact.lineage(w.graph, ids, None, w.even_scores).select(*IMPACT)


def every_catalog_path(w: Workspace) -> DataFrame:
    """From the nation of every customer to the customer."""
    pairs = w.table("customer").select(node_key("nation", "c_nationkey").alias("src"), node_key("customer", "c_custkey").alias("dst"))
    found = paths.shortest_paths(w.graph, pairs)
    text = F.coalesce(F.concat_ws(">", "path"), F.lit(""))
    return found.withColumn("path", text).withColumn("hops", F.col("hops").cast("long"))


def every_interval_member(w: Workspace) -> DataFrame:
    """What the interval of every artifact holds."""
    return labels.enclosed(w.labels, w.graph.nodes)


def reach_decisions(w: Workspace) -> DataFrame:
    """How each pair of ``indexed_reach`` was decided."""
    return _decided(w)


def impact_query_rows(w: Workspace) -> DataFrame:
    """The answer rows that belong to the heads of ``impact_query``."""
    rows = report.impact_query(w.graph, w.seeds, 2, w.even_scores)[1]
    return rows.withColumn("hops", F.col("hops").cast("long"))


def diffusion_scores(w: Workspace) -> DataFrame:
    """The score of every artifact when the damped rounds from the bare seeds are done."""
    start = w.seeds.select("node_id", F.col("probability").alias("risk"))
    return risk.diffusion(w.graph, start).scores.withColumn("risk", shown(F.col("risk")))


def impact_report_rows(w: Workspace) -> DataFrame:
    """The listed rows of every report in order, both sides, and the error of an id that is not in the catalog."""
    asked = w.seeds.select("node_id").unionByName(w.spark.createDataFrame([("nobody",)], "node_id string"))
    rows = impact.impact_reports(w.graph, asked, w.even_scores)
    sides = [F.struct(F.lit(side).alias("side"), F.col(column).alias("rows")) for side, column in (("down", "impacted_nodes"), ("up", "ancestor_nodes"))]
    cut = rows.select("query_id", "error", F.explode(F.array(*sides)).alias("s"))
    cut = cut.filter(F.col("error").isNull() | (F.col("s.side") == "down"))
    listed = cut.select("query_id", "error", "s.side", F.posexplode_outer("s.rows").alias("place", "r"))
    listed = listed.filter(F.col("place").isNotNull() | F.col("error").isNotNull())
    side = F.when(F.col("error").isNull(), F.col("side")).alias("side")
    cells = [F.col(f"r.{c}").alias(c) for c in ("node_id", "node_type", "risk")]
    return listed.select("query_id", "error", side, F.col("place").cast("long").alias("place"), *cells, F.col("r.hops").cast("long").alias("hops"))


# Over all ids, or whole answers.
WHOLE: dict[str, Callable[[Workspace], DataFrame]] = {
    "every_parent": every_parent,
    "every_cycle_node": every_cycle_node,
    "every_cycle_member": every_cycle_member,
    "witness_cycles": witness_cycles,
    "every_proof_target": every_proof_target,
    "every_proof_row": every_proof_row,
    "every_proof_verdict": every_proof_verdict,
    "every_impact": every_impact,
    "every_ancestor": every_ancestor,
    "every_catalog_path": every_catalog_path,
    "every_interval_member": every_interval_member,
    "reach_decisions": reach_decisions,
    "impact_query_rows": impact_query_rows,
    "diffusion_scores": diffusion_scores,
    "impact_report_rows": impact_report_rows,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The named query over the tables in ``folder``."""
    return (QUERIES | WHOLE)[name](Workspace.of(spark, folder))
