"""Exact top-k search by inner product of whole-number vectors, in blocks and buckets of similar length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm.integers import coded
from heirline.llm.lengthblocks import best_rows, into_blocks, least_copies, queries_of
from heirline.plans.scratch import Scratch

SCALE = 64
NEIGHBOURS = 20


def exact_top(spark: SparkSession, vectors: DataFrame, queries: Column, *, k: int = NEIGHBOURS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every row of ``vectors`` that ``queries`` holds for.

    A vector x has the components floor(scale * embedding), and the score is the inner product of two such vectors. Ties
    go to the smaller vec_id; ranks start at 1. All rows with another id than the query's are candidates; if there are
    fewer than ``k``, all are returned. Repeated rows are candidates each; of queries with one id, the smallest vector
    is asked. Rows without an id take no part, nor do vectors that are null, empty, with null or non-finite components,
    or of another length than most. Zero vectors take part. No usable rows give no result. Only vec_id and embedding are read.
    """
    scratch = Scratch(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull())
    made = coded(named, scale, "vec_id")
    if made is None:
        return empty
    rows, form = made
    rows = scratch.save(rows.withColumn("label", F.lit(None).cast("string")), scratch.place("codes")).df
    blocks = into_blocks(scratch, least_copies(rows, ["code"], k + 1), form)
    asked = queries_of(rows, queries, form)
    asked = asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    return best_rows(blocks, asked, k).select("query_id", "rank", "vec_id", "score")
