"""Spread of compromise probabilities and the figures drawn from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.functions.scalar import risk_level, round4
from heirline.plans.sweep import sweep, with_parent_values
from heirline.plans.tail import tail_pass
from heirline.schema import DIFFUSION_DAMPING, DIFFUSION_ROUNDS, DIFFUSION_TOLERANCE, RISK_LEVELS, SAFE_LEVEL
from heirline.sources.ingest import InvalidCatalog, clean_seeds, missing_seeds, require_none

LEVEL_NAMES = [name for name, _ in RISK_LEVELS] + [SAFE_LEVEL]


def accepted_seeds(graph, seeds: DataFrame) -> DataFrame:
    """(node_id, probability, layer) of the seeds, -1 for the tail, or an error for a bad one."""
    clean = clean_seeds(seeds)
    out = F.isnan("probability") | ~F.col("probability").between(0.0, 1.0)
    stored = graph.scratch.save(
        clean.join(graph.round_of, "node_id", "left"),
        graph.scratch.place("seeds"),
        figures={"unknown": F.count_if(F.col("layer").isNull()), "out": F.count_if(out)},
    )
    if stored.figures["unknown"]:
        require_none(missing_seeds(clean, graph.nodes), "seeds not in the catalog")
    if stored.figures["out"]:
        raise InvalidCatalog("seed probabilities must lie in [0, 1]")
    return stored.df


def noisy_or(factors: str):
    """1 minus the product of ``factors``, the chances that a parent does no harm."""
    return 1.0 - F.product(factors)


def _safe_chance(risk: float, weight: float) -> float:
    return 1.0 - weight * risk


def _at_least(seed: float | None, safe: list[float]) -> float:
    return max(seed if seed and seed > 0 else 0.0, 1.0 - math.prod(safe))


def propagate(graph, seeds: DataFrame) -> DataFrame:
    """(node_id, risk) of every artifact for the seeds (node_id[, probability]).

    A vertex is safe only if every parent leaves it safe: its risk is
    1 - prod(1 - weight * parent risk), and never below its own seed. Only vertices
    with some risk take part in the rounds.
    """
    placed = accepted_seeds(graph, seeds)

    def own(layer: int) -> DataFrame:
        return placed.filter(F.col("layer") == layer).select("node_id", F.col("probability").alias("seed"))

    def step(layer: int, edges: DataFrame, finished: DataFrame) -> DataFrame:
        risky = with_parent_values(graph, edges, finished.filter(F.col("risk") > 0))
        pushed = risky.select(
            F.col("dst").alias("node_id"), (1.0 - F.col("weight") * F.col("risk")).alias("safe"), F.lit(0.0).alias("seed")
        )
        rows = pushed.unionByName(own(layer).withColumn("safe", F.lit(1.0)))
        return rows.groupBy("node_id").agg(F.greatest(F.max("seed"), noisy_or("safe")).alias("risk"))

    def last(edges: DataFrame, finished: DataFrame) -> DataFrame:
        risky = with_parent_values(graph, edges, finished.filter(F.col("risk") > 0))
        above = risky.select(F.col("dst").alias("node_id"), (1.0 - F.col("weight") * F.col("risk")).alias("value"))
        mine = own(-1).withColumnRenamed("seed", "own")
        values = tail_pass(graph, mine, edges, above, _safe_chance, _at_least, "double")
        return values.filter("value > 0").withColumnRenamed("value", "risk")

    found = sweep(graph, "risk", own(0).withColumnRenamed("seed", "risk"), step, last)
    return graph.scratch.save(all_scores(graph.nodes, found), graph.scratch.place("scores")).df


def all_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(node_id, risk) of every artifact; 0.0 where there is no score."""
    some = scores.select("node_id", "risk")
    return nodes.select("node_id").join(some, "node_id", "left").na.fill(0.0, ["risk"])


def diffuse(
    graph,
    start: DataFrame,
    damping: float = DIFFUSION_DAMPING,
    rounds: int = DIFFUSION_ROUNDS,
    tolerance: float = DIFFUSION_TOLERANCE,
) -> tuple[DataFrame, int]:
    """Damped rounds from the scores ``start`` (node_id, risk); (scores, rounds run).

    All vertices move together: max(old, damping * noisy-or + (1 - damping) * old).
    Stops when no score changes by ``tolerance`` or more. The edges are bucketed by
    source, so a round shuffles scores and partial products only.
    """
    found = diffusion(graph, start, damping, rounds, tolerance)
    return found.scores, found.rounds


@dataclass(frozen=True)
class Diffusion:
    """Scores after ``rounds`` rounds; ``change`` is the largest of the last one, 0.0 without any."""

    scores: DataFrame
    rounds: int
    change: float
    converged: bool


def diffusion(
    graph,
    start: DataFrame,
    damping: float = DIFFUSION_DAMPING,
    rounds: int = DIFFUSION_ROUNDS,
    tolerance: float = DIFFUSION_TOLERANCE,
) -> Diffusion:
    """As :func:`diffuse`, and whether it came to its stop."""
    scratch = graph.scratch
    current = scratch.save(all_scores(graph.nodes, start), scratch.place("diffusion")).df
    done, change, converged = 0, 0.0, False
    while done < rounds and not converged:
        met = graph.forward.meet(current.filter(F.col("risk") > 0))
        safe = met.select(F.col("far").alias("node_id"), (1.0 - F.col("weight") * F.col("risk")).alias("safe"))
        pushed = safe.groupBy("node_id").agg(noisy_or("safe").alias("_pushed"))
        mixed = F.lit(damping) * F.col("_pushed") + F.lit(1.0 - damping) * F.col("risk")
        moved = (
            current.join(pushed, "node_id", "left")
            .withColumn("_new", F.when(F.col("_pushed").isNull(), F.col("risk")).otherwise(F.greatest("risk", mixed)))
            .select("node_id", F.col("_new").alias("risk"), (F.col("_new") - F.col("risk")).alias("change"))
        )
        stored = scratch.save(moved, scratch.place("diffusion"), figures={"delta": F.max(F.abs("change"))})
        current = stored.df.select("node_id", "risk")
        done += 1
        change = stored.figures["delta"] or 0.0
        converged = change < tolerance
    return Diffusion(current, done, change, converged)


def risk_of(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, risk, risk_level) per requested id; an id without score reads 0.0."""
    return all_scores(ids, scores).withColumn("risk_level", risk_level(F.col("risk")))


def ranked(scores: DataFrame) -> DataFrame:
    """All scores with their level, highest first."""
    return scores.withColumn("risk_level", risk_level(F.col("risk"))).orderBy(F.desc("risk"), "node_id")


def top_risks(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores; none for ``k <= 0``."""
    return ranked(scores).limit(max(0, k))


def level_counts(scores: DataFrame) -> DataFrame:
    """(risk_level, nodes) with all five levels."""
    levels = scores.sparkSession.createDataFrame([(n,) for n in LEVEL_NAMES], "risk_level string")
    counts = scores.groupBy(risk_level(F.col("risk")).alias("risk_level")).agg(F.count(F.lit(1)).alias("nodes"))
    return levels.join(counts, "risk_level", "left").na.fill(0, ["nodes"])


def risk_summary(scores: DataFrame) -> DataFrame:
    """One row: total, mean, highest and lowest score, and a map of level counts.

    No row without scores.
    """
    level = risk_level(F.col("risk"))
    cells = [c for n in LEVEL_NAMES for c in (F.lit(n), F.count_if(level == n))]
    return scores.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        round4(F.avg("risk")).alias("mean_risk"),
        F.greatest(F.lit(0.0), F.max("risk")).alias("max_risk"),
        F.least(F.lit(1.0), F.min("risk")).alias("min_risk"),
        F.create_map(*cells).alias("level_counts"),
    ).filter("total_nodes > 0")
