"""Headline operators on the catalog derived from the tables; prints one JSON line.

Every operator is timed on its own, with the inputs it shares with others (layouts,
layers, hashes or scores) made before. Results are written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline import LineageGraph
from heirline.operators import impact, merkle, paths, reach, reachindex, refresh, report, risk, topo
from heirline.plans import bitmaps
from heirline.sources import catalog_edges, catalog_nodes, catalog_seeds
from heirline.suite import Workspace

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("heirline-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    # Start-up of the session and first code paths, on the smallest lookups.
    sink(catalog_edges(spark, FOLDER).groupBy("src").agg(F.count("*")))
    work = Workspace(spark, FOLDER)
    took: dict[str, float] = {}

    def timed(name: str, job):
        begin = time.perf_counter()
        made = job()
        if isinstance(made, DataFrame):
            sink(made)
        took[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
        return made

    def ingest() -> None:
        work.once("graph", lambda: LineageGraph(catalog_nodes(spark, FOLDER), catalog_edges(spark, FOLDER), unique=True))

    timed("ingest", ingest)
    graph = work.graph
    timed("layouts", lambda: (graph.forward, graph.backward) and None)
    timed("layers", lambda: graph.layers)
    timed("edge_slices", lambda: graph.slices and None)
    timed("merkle_hashes", lambda: graph.hashes)
    timed("topo_order", lambda: topo.topological_order(graph))
    timed("risk", lambda: work.once("scores", lambda: risk.propagate(graph, catalog_seeds(spark, FOLDER))))
    timed("risk_summary", lambda: risk.risk_summary(work.scores))
    timed("risk_topk", lambda: risk.top_risks(work.scores, 20))
    timed("diffusion", lambda: risk.diffuse(graph, work.seeds.withColumnRenamed("probability", "risk"))[0])
    timed("tamper_check", lambda: merkle.detect_tampering(work.poisoned_hashes, graph.hashes))
    one = work.all_of("supplier", "supplier", "s_suppkey").filter("node_id = 'supplier_7'")
    timed("impact_one", lambda: impact.impacted(graph, one, None, work.scores))
    timed("impact_2_hops", lambda: impact.impacted(graph, work.seeds, 2, work.scores))
    timed("khop_sweep", lambda: reach.hop_counts(graph, work.seeds, 3))
    timed("ancestors", lambda: impact.lineage(graph, work.first_customers(), None, work.scores))
    timed("reach_pairs", lambda: reach.can_reach(graph, work.home_pairs()))
    timed("interval_labels", lambda: work.labels)
    timed("impact_report", lambda: impact.impact_reports(graph, work.seeds, work.scores))
    proof = timed("proofs", lambda: merkle.prove(graph, work.first_customers()))
    timed("verify", lambda: merkle.verify(proof))
    timed("graph_stats", lambda: report.graph_stats(graph, work.scores, work.seeds))
    timed("reach_index", lambda: work.index and work.index.labels)
    timed("indexed_pairs", lambda: reachindex.decide(graph, work.index, work.home_pairs()))
    suppliers = work.all_of("supplier", "supplier", "s_suppkey")
    timed("closures_of_suppliers", lambda: bitmaps.closure(graph, suppliers, "forward").reached)
    old = refresh.bucketed_hashes(graph, graph.hashes)
    timed("refreshed_hashes", lambda: refresh.refreshed_hashes(graph, work.poisoned, old).hashes)
    _ = (work.blocks.forward, work.blocks.backward)
    timed("shortest_paths", lambda: paths.shortest_paths(work.blocks, work.block_pairs()))

    size = os.path.basename(os.path.normpath(FOLDER)).removeprefix("sf")
    line = {
        "metric": "total time of the headline operators",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": float(size) if size.replace(".", "", 1).isdigit() else size,
        "nodes": graph.node_count,
        "edges": graph.edge_count,
        "cpus": int(CPUS),
        "spark": spark.version,
    }
    graph.release()
    work.blocks.release()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
