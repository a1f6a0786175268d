"""A catalog prepared for graph jobs.

:class:`LineageGraph` holds the cleaned ``nodes`` and ``edges`` and, made on first
use and then kept, the layouts and results that several operators share. The frames
it holds never change; new input makes a new graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.plans.adjacency import HOT_DEGREE, Adjacency, hot_limit, hot_vertices, salt_edges
from heirline.plans.scratch import Scratch, Stored
from heirline.plans.tail import DEEP_AFTER, PIECE_ROWS
from heirline.sources.ingest import bad_artifact, clean_edges, clean_nodes, problems, require_none

BUCKET_BYTES = 256 << 20
EDGE_BYTES = 48


class LineageGraph:
    """Typed artifacts and weighted "was used to create" edges between them."""

    def __init__(
        self,
        nodes: DataFrame,
        edges: DataFrame,
        *,
        unique: bool = False,
        validate: bool = True,
        hot_degree: int = HOT_DEGREE,
        deep_after: int = DEEP_AFTER,
        piece_rows: int = PIECE_ROWS,
        scratch: Scratch | None = None,
    ):
        """Clean, store and check the two tables.

        ``unique=True`` states that ids and edge pairs do not repeat. ``hot_degree`` is
        the degree above which the edges of a vertex are split over several tasks. What
        lies deeper than ``deep_after`` layers is done piece by piece where a piece has
        at most ``piece_rows`` edges.
        """
        self.spark: SparkSession = nodes.sparkSession
        self.scratch = scratch or Scratch(self.spark)
        self.hot_degree = hot_degree
        self.deep_after = deep_after
        self.piece_rows = piece_rows
        bad_node = F.count_if(bad_artifact())
        bad_weight = F.count_if(F.isnan("weight"))
        self._nodes = self._keep(clean_nodes(nodes, unique=unique), "nodes", figures={"bad": bad_node})
        self._edges = self._keep(clean_edges(edges, unique=unique), "edges", figures={"bad": bad_weight})
        if validate and (self._nodes.figures["bad"] or self._edges.figures["bad"] or self.degrees.figures["unknown"]):
            require_none(problems(self.nodes, self.edges), "catalog refused")

    def _keep(self, df: DataFrame, name: str, **options) -> Stored:
        return self.scratch.save(df, self.scratch.place(name), **options)

    @property
    def nodes(self) -> DataFrame:
        return self._nodes.df

    @property
    def edges(self) -> DataFrame:
        return self._edges.df

    @property
    def node_count(self) -> int:
        return self._nodes.rows

    @property
    def edge_count(self) -> int:
        return self._edges.rows

    @cached_property
    def degrees(self) -> Stored:
        """(node_id, in_degree, out_degree, known), zeros included, in one aggregation.

        ``known`` is 0 for an id that only edges name.
        """
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

        def ends(df: DataFrame, node_id: str, ins, outs, known) -> DataFrame:
            return df.select(
                F.col(node_id).alias("node_id"),
                ins.alias("in_degree"),
                outs.alias("out_degree"),
                known.alias("known"),
            )

        seen = (
            ends(self.nodes, "node_id", zero, zero, one)
            .unionByName(ends(self.edges, "src", zero, one, zero))
            .unionByName(ends(self.edges, "dst", one, zero, zero))
        )
        totals = seen.groupBy("node_id").agg(
            F.sum("in_degree").alias("in_degree"),
            F.sum("out_degree").alias("out_degree"),
            F.sum("known").alias("known"),
        )
        figures = {
            "unknown": F.count_if(F.col("known") == 0),
            "roots": F.count_if(F.col("in_degree") == 0),
            "leaves": F.count_if(F.col("out_degree") == 0),
            "top_in": F.max("in_degree"),
            "top_out": F.max("out_degree"),
        }
        return self._keep(totals, "degrees", figures=figures)

    @cached_property
    def split_degree(self) -> int:
        return hot_limit(self.edge_count, self.hot_degree)

    def _hot(self, end: str) -> DataFrame | None:
        if (self.degrees.figures[f"top_{end}"] or 0) <= self.split_degree:
            return None
        degree = F.col(f"{end}_degree").alias("degree")
        return hot_vertices(self.degrees.df.select("node_id", degree), self.split_degree)

    @cached_property
    def hot_sources(self) -> DataFrame | None:
        """(node_id, parts) of vertices with very many children; None without any."""
        return self._hot("out")

    @cached_property
    def hot_targets(self) -> DataFrame | None:
        """(node_id, parts) of vertices with very many parents; None without any."""
        return self._hot("in")

    @cached_property
    def buckets(self) -> int:
        """Bucket count of the adjacency tables, from their size, within what Spark allows."""
        by_size = -(-self.edge_count * EDGE_BYTES // BUCKET_BYTES)
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        return min(most, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by_size))

    @cached_property
    def forward(self) -> Adjacency:
        """Edges bucketed by source."""
        return self._adjacency("forward", "src", self.hot_sources, "dst", self.hot_targets)

    @cached_property
    def backward(self) -> Adjacency:
        """Edges bucketed by target."""
        return self._adjacency("backward", "dst", self.hot_targets, "src", self.hot_sources)

    def _adjacency(self, name, near, near_hot, far, far_hot) -> Adjacency:
        loose = self._salted(near, near_hot, far, far_hot)
        return Adjacency(self.scratch.save_bucketed(loose.table, name, loose.keys(), self.buckets), near_hot)

    def _salted(self, near, near_hot, far, far_hot) -> Adjacency:
        ends = self.edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "weight")
        salted = salt_edges(ends, near_hot, "near", "far", "near_salt")
        return Adjacency(salt_edges(salted, far_hot, "far", "near", "far_salt"), near_hot)

    @property
    def by_target(self) -> Adjacency:
        """Edges by target for a single join: the ``backward`` table if it is there, else the edges as they are."""
        if "backward" in self.__dict__:
            return self.backward
        return self._salted("dst", self.hot_targets, "src", self.hot_sources)

    @property
    def roots(self) -> DataFrame:
        """Vertices without parents."""
        return self.degrees.df.filter(F.col("in_degree") == 0).select("node_id")

    @property
    def leaves(self) -> DataFrame:
        """Vertices without children."""
        return self.degrees.df.filter(F.col("out_degree") == 0).select("node_id")

    @cached_property
    def _peeled(self):
        from heirline.operators.topo import require_acyclic

        return require_acyclic(self)

    @property
    def tail(self) -> Stored | None:
        """(node_id, component, layer) of deep vertices in small pieces; None without any."""
        return self._peeled.tail

    @property
    def rounds(self) -> int:
        """Number of layers outside the tail."""
        return self._peeled.depth

    @property
    def depth(self) -> int:
        """Number of layers."""
        return self.rounds if self.tail is None else max(self.rounds, self.tail.figures["top"] + 1)

    @property
    def layers(self) -> DataFrame:
        """(node_id, layer): 0 for roots, else one more than the deepest parent."""
        if self.tail is None:
            return self._peeled.layers
        return self._peeled.layers.unionByName(self.tail.df.select("node_id", "layer"))

    @property
    def round_of(self) -> DataFrame:
        """(node_id, layer) as sweeps go: the layer, or -1 for the tail."""
        if self.tail is None:
            return self._peeled.layers
        return self._peeled.layers.unionByName(self.tail.df.select("node_id", F.lit(-1).alias("layer")))

    @cached_property
    def slices(self) -> Stored:
        """Edges with the layer of their target, stored by layer."""
        from heirline.plans.sweep import edge_slices

        return edge_slices(self)

    @cached_property
    def pushed_forward(self):
        """Edges by the layer of their source, for pushing values down."""
        from heirline.plans.push import pushed_edges

        return pushed_edges(self, "forward")

    @cached_property
    def pushed_backward(self):
        """Edges by the layer of their target, for pushing values up."""
        from heirline.plans.push import pushed_edges

        return pushed_edges(self, "backward")

    @cached_property
    def hashes(self) -> DataFrame:
        """(node_id, hash) of the chained content hashes."""
        from heirline.operators.merkle import hash_chain

        return hash_chain(self)

    def extended(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> LineageGraph:
        """A new graph with a further batch of artifacts and edges; this one stays as it is.

        A row of the batch replaces the one with the same id or pair. The batch is
        cleaned on its own, and the rows kept are those it does not name.
        """

        def merged(old: DataFrame, batch: DataFrame | None, clean: Callable, keys: list[str]) -> DataFrame:
            if batch is None:
                return old
            new = clean(batch)
            return old.join(new.select(*keys), keys, "left_anti").unionByName(new)

        return LineageGraph(
            merged(self.nodes, nodes, clean_nodes, ["node_id"]),
            merged(self.edges, edges, clean_edges, ["src", "dst"]),
            unique=True,
            hot_degree=self.hot_degree,
            deep_after=self.deep_after,
            piece_rows=self.piece_rows,
        )

    def release(self) -> None:
        """Drop everything the graph has written."""
        self.scratch.release()
