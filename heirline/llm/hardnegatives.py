"""Hard negatives: for an anchor and a positive of its label, rows of other labels that score nearly as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm.integers import coded
from heirline.llm.lengthblocks import best_rows, into_blocks, least_copies, queries_of
from heirline.plans.scratch import Scratch

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's score, in percent of the positive's.
LEAST_PERCENT = 30
MOST_PERCENT = 90


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``anchors`` holds for.

    A vector x has the components floor(scale * embedding); a row's score is its inner product with the anchor, and rows
    are taken by falling score, then smaller vec_id. Positives are the first rows of the anchor's label, negatives of a
    positive the first rows of another label whose score is between ``percent`` of the positive's, limits included. So a
    positive with a negative score has none, and one with score 0 those with score 0. If there are fewer, all are returned; an
    anchor without positives, or a positive without negatives, has no rows.

    Rows with a null vec_id, label or vector take no part, nor do empty vectors, vectors with null or non-finite components
    or of another length than most. Rows with the anchor's own id are neither positive nor negative. Repeated rows count each; of anchors
    with one id, the smallest vector (then label) is asked. No usable rows give no result. Only vec_id, embedding
    and label are read.
    """
    scratch = Scratch(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    made = coded(named.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), scale, "vec_id", "label")
    if made is None:
        return spark.createDataFrame([], schema)
    rows, form = made
    rows = scratch.save(rows, scratch.place("codes")).df
    blocks = into_blocks(scratch, least_copies(rows, ["code", "label"], max(positives, negatives) + 1), form)
    asked = scratch.save(queries_of(rows, anchors, form), scratch.place("anchors")).df

    open_ = asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    near = best_rows(blocks, open_, positives, "same").select("query_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = scratch.save(near, scratch.place("positives")).df

    # One slot for each place among the positives. Nothing fits one that is missing or has a negative score.
    by_place = near.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "positive_score"))).alias("_scores"))

    def limits(percent: int, rounded, missing: float) -> Column:
        score = [F.col("_scores")[i + 1].cast("double") for i in range(positives)]
        return F.array(*[F.when(s >= 0, rounded(s * percent / 100).cast("double")).otherwise(F.lit(missing)) for s in score])

    banded = asked.join(by_place, "query_id").withColumn("low", limits(percent[0], F.ceil, float("inf")))
    banded = banded.withColumn("high", limits(percent[1], F.floor, float("-inf"))).drop("_scores")
    found = best_rows(blocks, banded, negatives, "other")
    pairs = found.join(near.withColumnRenamed("rank", "_place"), ["query_id"]).filter(F.col("slot") + 1 == F.col("_place"))
    return pairs.select(
        F.col("query_id").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
