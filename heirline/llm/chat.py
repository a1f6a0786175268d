"""Chat formatting with Spark expressions only.

A conversation becomes one text. Adjacent turns of one role share a block; within it, a separator keeps
them apart, so that the turns can be read back. Control strings inside texts are escaped with a
backslash, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template (fixed values).
START = "<|im_start|>"
NEXT = "<|im_sep|>"
END = "<|im_end|>\n"
TRAINED_ROLE = "assistant"

FORMATTED = "conv_id long, text string, loss array<struct<begin:int,length:int>>"


def escaped(text: Column) -> Column:
    """``text`` without the character pair that control strings start with; backslashes are doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    """As :func:`escaped`, with line feeds escaped too, since one ends the role."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescaped_role(role: Column) -> Column:
    """The inverse of :func:`escaped_role`. Between doubled backslashes, every backslash is an escape."""
    parts = F.split(role, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def _blocks(turns: Column) -> Column:
    """Merge sorted (turn, role, text) structs of one role that stand next to each other.

    Turn i starts a block if it is the first or its role differs from the one before; a block goes on to the next start.
    """
    size = F.size(turns)
    starts = F.filter(
        F.transform(turns, lambda t, i: F.when((i == 0) | (t["role"] != F.get(turns, i - 1)["role"]), i).otherwise(F.lit(-1))),
        lambda i: i >= 0,
    )
    return F.transform(
        starts,
        lambda at, k: F.struct(
            F.get(turns, at)["role"].alias("role"),
            F.transform(
                F.slice(turns, at + 1, F.coalesce(F.get(starts, k + 1), size) - at), lambda t: t["text"]
            ).alias("texts"),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, text, loss): every conversation as one text and the places of what is trained on.

    Takes (conv_id, turn, role, text). Turns go by ``turn``, nulls first, then by role and text; repeated rows stay.
    A null role or text is empty; a null conv_id is a conversation of its own. ``loss`` holds (begin,
    length) in characters, from 0, of every text of the assistant as it stands in the output, control strings left out. Other
    columns are not read; no turns give no rows.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        escaped_role(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    gathered = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = gathered.withColumn("blocks", _blocks(F.col("turns")))
    # Each block: its text, and the length of everything before its first turn's text.
    rendered = merged.withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: F.struct(
                F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(END)).alias("text"),
                (F.length(b["role"]) + len(START) + 1).alias("head"),
                b["role"].alias("role"),
                F.transform(b["texts"], F.length).alias("lengths"),
            ),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans"))

    def add_turn(state: Column, length: Column) -> Column:
        span = F.struct(state["at"].alias("begin"), length.alias("length"))
        return F.struct((state["at"] + length + len(NEXT)).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def add_block(state: Column, block: Column) -> Column:
        begin = F.struct((state["at"] + block["head"]).alias("at"), state["spans"].alias("spans"))
        inside = F.aggregate(block["lengths"], begin, add_turn)["spans"]
        return F.struct(
            (state["at"] + F.length(block["text"])).alias("at"),
            F.when(block["role"] == TRAINED_ROLE, inside).otherwise(state["spans"]).alias("spans"),
        )

    return rendered.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("text"),
        F.aggregate("blocks", zero, add_block)["spans"].alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    blocks = F.split(text, r"<\|im_end\|>\n", -1)
    full = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        head = F.instr(block, "\n")
        role = unescaped_role(block.substr(F.lit(len(START) + 1), head - len(START) - 1))
        texts = F.split(block.substr(head + 1, F.length(block)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(full, turns_of))


def loss_texts(text: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped: an array of texts."""
    return F.transform(loss, lambda s: unescaped(text.substr(s["begin"] + 1, s["length"])))
