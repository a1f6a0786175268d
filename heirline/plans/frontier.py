"""Breadth-first walks from many starts at once."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.plans.adjacency import hot_limit, hot_vertices, repeat_hot
from heirline.plans.scratch import Stored
from heirline.plans.sweep import slice_of

VISITED = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("budget", T.IntegerType()),
        T.StructField("hops", T.IntegerType()),
    ]
)
# Frontiers of at most so many rows are pushed into the scan as a list of ids.
LISTED_IDS = 2_000


def short_id_list(frontier: Stored, limit: int = LISTED_IDS) -> list[str] | None:
    """Ids of a frontier of at most ``limit`` rows, for pushing into the scan; None if longer.

    The scan then opens only the buckets of these ids. A longer frontier reaches most buckets.
    """
    if frontier.rows > limit:
        return None
    return sorted({r.node_id for r in frontier.df.select("node_id").take(limit)})


def crowded(graph, frontier: Stored, queries: int) -> DataFrame | None:
    """(node_id, parts) of vertices that very many queries stand on; None without any.

    A query stands on a vertex once, so this can only happen with that many queries.
    """
    limit = hot_limit(frontier.rows, graph.hot_degree)
    if min(queries, frontier.rows) <= limit:
        return None
    counts = frontier.df.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    found = graph.scratch.save(hot_vertices(counts, limit), graph.scratch.place("crowded"))
    return found.df if found.rows else None


def neighbours(graph, frontier: Stored, direction: str, queries: int) -> DataFrame:
    """The rows of ``frontier`` moved one edge on: its columns, ``_at`` and the new ``node_id``.

    Rows on a vertex that very many queries share are spread over salts, and the edges
    of that vertex repeated for each.
    """
    side = getattr(graph, direction)
    kept = [c for c in frontier.df.columns if c != "node_id"]
    columns = [*kept, "_at", F.col("far").alias("node_id")]
    crowd = crowded(graph, frontier, queries)
    if crowd is None:
        return side.meet(frontier.df, short_id_list(frontier)).select(*columns)
    names = F.broadcast(crowd.select("node_id"))
    few = side.meet(frontier.df.join(names, "node_id", "left_anti")).select(*columns)
    many = frontier.df.join(F.broadcast(crowd), "node_id").withColumn(
        "_salt", F.pmod(F.xxhash64(*kept), F.col("parts").cast("long")).cast("int")
    )
    edges = side.table.select("near", "far").join(names, F.col("near") == names["node_id"], "left_semi")
    spread = repeat_hot(edges, crowd, "near", "_edge_salt")
    on = (many["node_id"] == spread["near"]) & (many["_salt"] == spread["_edge_salt"])
    moved = many.withColumn("_at", F.col("node_id")).join(spread, on).select(*columns)
    return few.unionByName(moved)


def walk(graph, starts: DataFrame, direction: str, max_hops: int | None = None) -> DataFrame:
    """(query_id, node_id, hops) of everything within ``max_hops``, starts at 0 hops.

    ``starts`` holds (query_id, node_id) and may hold ``budget``, the number of hops
    after which that start stops. Vertices already reached are pruned each
    round, so a row appears once, with its least hops. All starts walk together, whatever their
    number: every round is written, so only disk bounds them.
    """
    scratch = graph.scratch
    base = scratch.place(f"walk-{direction}")
    budget = F.max("budget" if "budget" in starts.columns else F.lit(None)).cast("int").alias("budget")
    frontier = scratch.save(starts.groupBy("query_id", "node_id").agg(budget), f"{base}/hops=0")
    queries = frontier.rows
    hops = 0
    late = None
    while frontier.rows and (max_hops is None or hops < max_hops):
        if hops == graph.deep_after + 1 and graph.tail is not None:
            frontier, late = finish_pieces(graph, frontier, direction, hops, base)
            if direction == "backward":
                late = relax(graph, frontier, late, hops, base, queries)
                break
            if not frontier.rows:
                break
        met = (
            neighbours(graph, frontier, direction, queries)
            .filter(F.col("budget").isNull() | (F.col("budget") > hops))
            .groupBy("query_id", "node_id")
            .agg(F.max("budget").alias("budget"))
        )
        seen = scratch.read(base, VISITED).select("query_id", "node_id")
        hops += 1
        frontier = scratch.save(met.join(seen, ["query_id", "node_id"], "left_anti"), f"{base}/hops={hops}")
    found = scratch.read(base, VISITED)
    if late is not None:
        least = found.unionByName(late).groupBy("query_id", "node_id")
        found = least.agg(F.max("budget").alias("budget"), F.min("hops").alias("hops"))
        found = found.filter(F.col("budget").isNull() | (F.col("hops") <= F.col("budget")))
    if max_hops is not None:
        found = found.filter(F.col("hops") <= max_hops)
    return found.drop("budget")


def finish_pieces(graph, frontier: Stored, direction: str, hops: int, base: str) -> tuple[Stored, DataFrame]:
    """Walk to the end inside the small deep pieces, one group per query and piece.

    Returns the frontier outside the pieces and the rows found inside.
    """
    scratch = graph.scratch
    place = graph.tail.df.select("node_id", "component")
    at = frontier.df.join(place, "node_id")
    groups = scratch.save(at.select("query_id", "component", "budget").distinct(), f"{base}-groups").df
    visited = scratch.read(base, VISITED).join(place, "node_id").join(groups.drop("budget"), ["query_id", "component"])

    within = place.select(F.col("node_id").alias("src"), "component")
    edges = slice_of(graph, -1).join(within, "src").select("src", "dst", "component")
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    rows = visited.select(
        "query_id", "component", "node_id", "hops", "budget", F.lit(None).cast("string").alias("far")
    ).unionByName(
        edges.join(groups, "component").select(
            "query_id", "component", F.col(near).alias("node_id"), F.lit(None).cast("int").alias("hops"), "budget",
            F.col(far).alias("far"),
        )
    )

    def grow(key: tuple, piece: pd.DataFrame) -> pd.DataFrame:
        links = piece[piece["far"].notna()]
        ahead = defaultdict(list)
        for a, b in zip(links["node_id"], links["far"], strict=True):
            ahead[a].append(b)
        known = piece[piece["far"].isna()]
        seen = set(known["node_id"])
        level = list(known.loc[known["hops"] == hops, "node_id"])
        step, found = hops, []
        while level:
            step += 1
            level = list({b for a in level for b in ahead[a] if b not in seen})
            seen.update(level)
            found += [(key[0], n, step) for n in level]
        out = pd.DataFrame(found, columns=["query_id", "node_id", "hops"])
        out["budget"] = pd.array([piece["budget"].iloc[0]] * len(out), dtype="Int32")
        return out

    schema = "query_id string, node_id string, hops int, budget int"
    inside = rows.groupBy("query_id", "component").applyInPandas(grow, schema)
    found = scratch.save(inside, f"{base}-late/round=0").df.select(*VISITED.names)
    rest = frontier.df.join(place.select("node_id"), "node_id", "left_anti").select(*frontier.df.columns)
    return scratch.save(rest, f"{base}-rest"), found


def relax(graph, frontier: Stored, found: DataFrame, hops: int, base: str, queries: int) -> DataFrame:
    """Go on upward from finished pieces: rows of different hops, kept where they are nearer.

    Starts from the pieces' rows and from ``frontier``. What lies above the pieces has few
    layers, so few rounds improve anything. Returns all rows found, some more than once.
    """
    scratch = graph.scratch
    edge = scratch.read(base, VISITED).filter(F.col("hops") == hops).unionByName(found)
    now = scratch.save(edge, f"{base}-edge")
    inside = graph.tail.df.select("node_id")
    rounds = 0
    while now.rows:
        met = neighbours(graph, now, "backward", queries).withColumn("hops", F.col("hops") + 1)
        if not rounds:
            met = met.join(inside, "node_id", "left_anti")
        nearest = met.groupBy("query_id", "node_id").agg(F.max("budget").alias("budget"), F.min("hops").alias("hops"))
        known = scratch.read(base, VISITED)
        known = known.unionByName(scratch.read(f"{base}-late", VISITED).select(*VISITED.names))
        best = known.groupBy("query_id", "node_id").agg(F.min("hops").alias("_best"))
        better = nearest.join(best, ["query_id", "node_id"], "left").filter(
            F.col("_best").isNull() | (F.col("hops") < F.col("_best"))
        )
        rounds += 1
        now = scratch.save(better.select(*VISITED.names), f"{base}-late/round={rounds}")
    return scratch.read(f"{base}-late", VISITED).select(*VISITED.names)
