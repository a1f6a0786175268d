"""The operators applied to the whole tables of a folder; one query per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import (
    chat,
    decontaminate,
    exacttopk,
    hardnegatives,
    licenses,
    neardup,
    neighbours,
    packing,
    quality,
    shards,
    substrings,
    tokens,
    whitening,
)

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out() -> Column:
    """A third of the ids; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def quality_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Learned from the labelled rows that are not held out."""
    return quality.train(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document; a third of the ids is held out from training."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(spark, docs, quality_weights(docs, table(spark, folder, "labels")))
    label = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", label.alias("predicted"))


def op2_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that a document repeats from an earlier one."""
    found = substrings.repeated_passages(spark, table(spark, folder, "documents"))
    return found.select("doc_id", "source_id", "start_word", "n_words", "similarity")


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of as many rows, equal texts side by side."""
    return shards.assign_shards(spark, table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, with a checksum of their ids."""
    docs = table(spark, folder, "documents")
    pieces = packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return licenses.scan_licenses(spark, table(spark, folder, "documents")).drop("spans")


def op6_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the turns and of the trained texts as read back from the formatted conversations.

    Conversation -1, whose texts hold control strings, is formatted along.
    """
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.format_chats(turns)
    read = made.select(
        "conv_id",
        chat.read_turns(F.col("text")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("text"), F.col("loss")), "").alias("trained"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window of each item."""
    return decontaminate.leaks(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors of largest inner product with every vector whose id is divisible by 20."""
    return neighbours.nearest(spark, table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document by two-word shingles, and whether it is the one kept."""
    found = neardup.near_duplicates(spark, table(spark, folder, "documents"), n=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is longer than 2048 tokens."""
    counted = tokens.token_counts(spark, table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the four leading components, whitened."""
    return whitening.whiten(spark, table(spark, folder, "embeddings"))


def op12_exact_top(spark: SparkSession, folder: str) -> DataFrame:
    """The exact 20 best whole-number vectors of every vector whose id is divisible by 20."""
    return exacttopk.exact_top(spark, table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; a seventh of the labels is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hardnegatives.hard_negatives(spark, vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_shards": op3_shards,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_chats": op6_chats,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_exact_top": op12_exact_top,
    "op13_hard_negatives": op13_hard_negatives,
}
# Vectors in whole numbers. A double holds their inner products exactly.
WHOLE_VECTORS = """
    SELECT *, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
"""
ORACLE: dict[str, str] = {
    "op12_exact_top": f"""
        WITH whole AS ({WHOLE_VECTORS.format(scale=exacttopk.SCALE)}), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q, whole c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_hard_negatives": f"""
        WITH whole AS ({WHOLE_VECTORS.format(scale=hardnegatives.SCALE)}), named AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, v FROM whole WHERE label IS NOT NULL
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.l = c.l AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM named a, named c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id, same ORDER BY score DESC, vec_id) AS place FROM scored
        ), paired AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM placed p JOIN placed n ON p.anchor_id = n.anchor_id AND p.same AND NOT n.same AND p.place <= 5
                AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        ), ranked AS (
            SELECT anchor_id, positive_id, CAST(row_number() OVER (
                PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
                negative_id, positive_score, negative_score FROM paired
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op6_chats": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), marked AS (
            SELECT *,
                length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n_text,
                length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) AS n_role,
                coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
                AS loss_sha256,
            CAST(sum(n_text + CASE WHEN goes_on THEN length('<|im_sep|>')
                ELSE length('<|im_start|>') + n_role + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
