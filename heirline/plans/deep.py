"""Depths in deep pieces that are too large for one group.

Vertices are dealt to clusters of neighbours, in rounds in which clusters join up to a size. Where an edge leads from one cluster
to another, its ends are gates. Each cluster is replaced by the longest ways from its gates in to its gates out, which leaves
a smaller graph with the same depths at the gates. That one is solved in the same way. Then each cluster knows when its gates
are reached, and orders the rest on its own, all clusters in one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heirline.plans.scratch import Scratch, Stored

# Rounds without a merge after which clusters are taken as they are: coins may fall badly.
IDLE_ROUNDS = 4
# Longest ways held at a time in one task, 8 bytes each.
CELLS = 1 << 24
NEVER = -(1 << 60)
ROWS = ["cluster", "src", "dst", "steps", "role"]


def clusters(scratch: Scratch, edges: DataFrame, most: int) -> DataFrame:
    """(node_id, cluster) of the vertices of (src, dst); the degrees of a cluster of several vertices add up to ``most`` or less.

    In each round half of the clusters, drawn by lot, join the one of the others to which most of their edges lead, as far as it has room.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = both.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    alone = both.groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    members = scratch.save(alone.withColumn("cluster", F.col("node_id")), scratch.place("clusters"))
    links = both.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    links = scratch.save(links, scratch.place("links"))
    turn = idle = 0
    while links.rows and idle < IDLE_ROUNDS:
        sizes = members.df.groupBy("cluster").agg(F.sum("degree").alias("size"))
        drawn = [F.xxhash64(c, F.lit(turn)).bitwiseAND(1) == side for c, side in (("a", 0), ("b", 1))]
        offers = links.df.filter(drawn[0] & drawn[1])
        for c in "ab":
            offers = offers.join(sizes.select(F.col("cluster").alias(c), F.col("size").alias(f"size_{c}")), c)
        offers = offers.filter(F.col("size_a") + F.col("size_b") <= most)
        best = offers.groupBy("a", "size_a").agg(F.max(F.struct("n", "b", "size_b")).alias("to")).select("a", "size_a", "to.*")
        taken = F.sum("size_a").over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
        fitting = best.withColumn("_taken", taken).filter(F.col("size_b") + F.col("_taken") <= most)
        moves = scratch.save(fitting.select(F.col("a").alias("_old"), F.col("b").alias("_new")), scratch.place("moves"))
        turn, idle = turn + 1, 0 if moves.rows else idle + 1
        if not moves.rows:
            continue

        def moved(df: DataFrame, column: str, moves: Stored = moves) -> DataFrame:
            joined = df.join(moves.df, df[column] == moves.df["_old"], "left")
            return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

        before = members, links
        members = scratch.save(moved(members.df, "cluster"), scratch.place("clusters"))
        joined = moved(moved(links.df, "a"), "b").filter("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
        links = scratch.save(joined, scratch.place("links"))
        scratch.discard(*before, moves)
    return members.df.select("node_id", "cluster")


class _Piece:
    """The vertices of some rows, as numbers in order, with their depths; those on or below a cycle are ``stuck``."""

    def __init__(self, rows: pd.DataFrame):
        codes, self.names = pd.factorize(pd.concat([rows["dst"], rows["src"]], ignore_index=True))
        self.dst, src = codes[: len(rows)], codes[len(rows) :]
        self.role = rows["role"].to_numpy()
        edge, base, stuck = (self.role == r for r in ("edge", "base", "stuck"))
        steps = rows["steps"].fillna(0).to_numpy(np.int64)
        count = len(self.names)
        depth = np.zeros(count, np.int64)
        np.maximum.at(depth, self.dst[base], steps[base])
        missing = np.bincount(self.dst[edge | stuck], minlength=count).tolist()
        by_src = np.argsort(src[edge], kind="stable")
        self.first = np.searchsorted(src[edge][by_src], np.arange(count + 1)).tolist()
        self.to, self.steps = self.dst[edge][by_src].tolist(), steps[edge][by_src].tolist()
        self.depth = depth.tolist()
        self.order = [v for v in range(count) if not missing[v]]
        for v in self.order:  # grows on the way
            for k in range(self.first[v], self.first[v + 1]):
                child = self.to[k]
                self.depth[child] = max(self.depth[child], self.depth[v] + self.steps[k])
                missing[child] -= 1
                if not missing[child]:
                    self.order.append(child)
        self.stuck = np.array(missing, np.int64) > 0

    def gates(self, role: str) -> np.ndarray:
        return np.unique(self.dst[self.role == role])

    def ways(self, begin: np.ndarray) -> np.ndarray:
        """(vertices x begin) longest ways, ``NEVER`` or a little more where there is none."""
        found = np.full((len(self.names), len(begin)), NEVER, np.int64)
        found[begin, np.arange(len(begin))] = 0
        for v in self.order:
            for k in range(self.first[v], self.first[v + 1]):
                child = found[self.to[k]]
                np.maximum(child, found[v] + self.steps[k], out=child)
        return found


def _contracted(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges from the gates in (i...) of one cluster to its gates out (o...), and the depths that these have without any gate in."""
    piece = _Piece(rows)
    ins, outs = piece.gates("in"), piece.gates("out")
    names = piece.names.to_numpy(object)
    # A vertex that waits for itself is never ordered.
    lost = ["o" + n for n in names[outs[piece.stuck[outs]]]]
    ins, outs = ins[~piece.stuck[ins]], outs[~piece.stuck[outs]]
    source, target, steps = [*lost, *[None] * len(outs)], [*lost, *("o" + n for n in names[outs])], [1] * len(lost)
    steps += [piece.depth[o] for o in outs]
    share = max(1, CELLS // max(1, len(names)))
    for at in range(0, len(ins) if len(outs) else 0, share):
        begin = ins[at : at + share]
        ways = piece.ways(begin)[outs]
        o, i = np.nonzero(ways >= 0)
        source += ["i" + n for n in names[begin[i]]]
        target += ["o" + n for n in names[outs[o]]]
        steps += ways[o, i].tolist()
    return pd.DataFrame({"src": pd.Series(source, dtype=object), "dst": pd.Series(target, dtype=object), "steps": pd.Series(steps, dtype="int64")})


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    piece = _Piece(rows)
    depth = pd.array(piece.depth, dtype="Int64")
    depth[piece.stuck] = pd.NA
    return pd.DataFrame({"node_id": piece.names.to_numpy(object), "depth": depth})


def longest(scratch: Scratch, edges: Stored, most: int) -> Stored | None:
    """(node_id, depth): the longest way along (src, dst, steps) that ends at a vertex; null on or below a cycle.

    A row without ``src`` gives the least depth of ``dst``. No group holds more than ``most`` edges within its cluster. None
    if clusters have so many gates that the graph would not shrink to half.
    """
    role = F.when(F.col("src").isNull(), "base").otherwise("edge").alias("role")
    if edges.rows <= most:
        rows = edges.df.select(F.lit("").alias("cluster"), "src", "dst", "steps", role)
        return scratch.save(rows.groupBy("cluster").applyInPandas(_solved, "node_id string, depth long"), scratch.place("depths"))
    # An edge within a cluster counts at both of its ends.
    dealt = clusters(scratch, edges.df.filter(F.col("src").isNotNull()), 2 * most)
    ends = [dealt.select(F.col("node_id").alias(c), F.col("cluster").alias(f"_{c}")) for c in ("src", "dst")]
    placed = edges.df.join(ends[1], "dst").join(ends[0], "src", "left").select("src", "dst", "steps", role, "_src", "_dst")
    placed = scratch.save(placed, scratch.place("placed")).df
    across = F.col("src").isNotNull() & (F.col("_src") != F.col("_dst"))
    crossing = placed.filter(across)

    def gates(end: str, role: str) -> DataFrame:
        none = [F.lit(None).cast("string").alias("src"), F.col(end).alias("dst"), F.lit(None).cast("long").alias("steps")]
        return crossing.select(F.col(f"_{end}").alias("cluster"), *none, F.lit(role).alias("role")).distinct()

    inside = placed.filter(~across).select(F.col("_dst").alias("cluster"), "src", "dst", "steps", "role")
    rows = scratch.save(inside.unionByName(gates("dst", "in")).unionByName(gates("src", "out")), scratch.place("cut")).df
    counts = rows.groupBy("cluster").agg(*[F.count_if(F.col("role") == r).alias(f"_{r}") for r in ("in", "out")])
    left = (counts.agg(F.sum((F.col("_in") + 1) * F.col("_out"))).first()[0] or 0) + crossing.count()
    if 2 * left > edges.rows:
        return None
    smaller = rows.groupBy("cluster").applyInPandas(_contracted, "src string, dst string, steps long")
    led = crossing.select(F.concat(F.lit("o"), "src").alias("src"), F.concat(F.lit("i"), "dst").alias("dst"), "steps")
    found = longest(scratch, scratch.save(smaller.unionByName(led), scratch.place("smaller")), most)
    if found is None:
        return None
    arrived = found.df.filter(F.col("node_id").startswith("i")).select(F.expr("substring(node_id, 2)").alias("dst"), F.col("depth").alias("steps"))
    known = rows.filter("role = 'in'").select("cluster", "src", "dst").join(arrived, "dst")
    known = known.withColumn("role", F.when(F.col("steps").isNull(), "stuck").otherwise("base"))
    solved = rows.filter("role <> 'in'").unionByName(known.select(*ROWS)).groupBy("cluster").applyInPandas(_solved, "node_id string, depth long")
    return scratch.save(solved, scratch.place("depths"))


def take_deep(graph, waiting: DataFrame, first: int) -> Stored | None:
    """(node_id, layer) of the waiting vertices that edges join; null on or below a cycle. None without any, or if they cannot be cut.

    ``first`` is the layer of a waiting vertex that waits for no other waiting one.
    """
    scratch = graph.scratch
    met = graph.forward.meet(waiting.select("node_id"))
    inner = scratch.save(met.select(F.col("near").alias("src"), F.col("far").alias("dst"), F.lit(1).cast("long").alias("steps")), scratch.place("deep"))
    found = longest(scratch, inner, graph.piece_rows) if inner.rows else None
    if found is None:
        return None
    layers = found.df.select("node_id", (F.col("depth") + first).cast("int").alias("layer"))
    return scratch.save(layers, scratch.place("deep"), figures={"stuck": F.count_if(F.col("layer").isNull()), "top": F.max("layer")})
