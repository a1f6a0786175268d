"""Balanced label propagation: documents with equal texts move to one shard, under quotas.

Documents start on a shard by a hash. Documents with the same text and shard form a cell, and cells are the
units that move. In each round every group of equal texts wants to be where most of it is; moves
are accepted up to a quota per shard, so that no shard holds more linked documents than it has room
for; a group too large for that gathers on ever fewer shards. At the end a shard with too many documents gives the excess, unlinked documents first, to those with too few, and
counts differ by one at most. All steps are joins and aggregates of DataFrames; the driver sees only a flow of shards x shards numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm.ranks import running_rank
from heirline.plans.scratch import Scratch

SHARDS = 24
ROUNDS = 6
LAW = "rows"


def _accepted(flow: dict[tuple[int, int], int], load: list[int], room: list[int]) -> list[float]:
    """The share of the wanted moves into each shard that fits, given what moves out."""
    shards = len(load)
    share = [1.0] * shards
    wanted = [sum(flow.get((i, j), 0) for i in range(shards)) for j in range(shards)]
    for _ in range(50):
        leaving = [sum(n * share[j] for (i, j), n in flow.items() if i == s) for s in range(shards)]
        share = [
            min(1.0, max(0.0, (room[j] - load[j] + leaving[j]) / wanted[j])) if wanted[j] else 0.0 for j in range(shards)
        ]
    return share


def _propagate(scratch: Scratch, cells: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """(text_id, origin, n, copies, shard) after the rounds; ``cells`` holds the linked documents."""
    shards = len(room)
    # A group moves as a whole, a large one cell by cell.
    large = F.col("copies") * 4 > room[0]
    now = scratch.save(cells.withColumn("shard", F.col("origin")), scratch.place("cells")).df
    for turn in range(rounds):
        there = now.groupBy("text_id", "shard").agg(F.sum("n").alias("weight"))
        load = [0] * shards
        for shard, n in there.groupBy("shard").agg(F.sum("weight")).collect():
            load[shard] = n
        # Shards without room are no aim. The places of a group, at most one per shard, by falling weight.
        full = [j for j in range(shards) if load[j] >= room[j]]
        open_there = there.filter(~F.col("shard").isin(full))
        places = F.sort_array(F.collect_list(F.struct("weight", (-F.col("shard")).alias("shard"))), asc=False)
        best = open_there.groupBy("text_id").agg(places.alias("places"))
        wish = now.join(there, ["text_id", "shard"]).join(best, "text_id", "left")
        count = F.size("places")
        own = F.array_position(F.transform("places", lambda p: -p["shard"]), F.col("shard"))
        # A group goes where most of it is; the lighter half of a large group's places goes to the heavier half.
        target = F.when(large & (own * 2 > count + 1), F.get("places", (count - own).cast("int"))).when(~large, F.get("places", F.lit(0)))
        wish = wish.withColumn("aim", -target["shard"]).withColumn("aim_weight", target["weight"])
        # What has gathered in a full shard leaves it only for as many.
        stays = F.col("shard").isin(full) & (F.col("aim_weight") < F.col("weight"))
        moves = F.coalesce((F.col("aim") != F.col("shard")) & ~stays, F.lit(False))
        wish = wish.drop("places")
        wish = scratch.save(wish.withColumn("moves", moves), scratch.place("wishes")).df
        flows = wish.filter("moves").groupBy("shard", "aim").agg(F.sum("n")).collect()
        flow = {(i, j): n for i, j, n in flows}
        if not flow:
            break
        share = _accepted(flow, load, room)
        quota = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("aim") + 1)
        unit = F.xxhash64("text_id", F.when(large, F.col("origin")), F.lit(turn))
        drawn = F.pmod(unit, F.lit(1_000_000)) / 1_000_000
        accept = F.col("moves") & (drawn < quota)
        now = scratch.save(
            wish.select("text_id", "origin", "n", "copies", F.when(accept, F.col("aim")).otherwise(F.col("shard")).alias("shard")),
            scratch.place("cells"),
        ).df
    return now


def assign_shards(spark: SparkSession, docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, with as many rows in all shards.

    Rows with equal texts are linked. Size is the UTF-8 length plus 8. Null texts count as empty and are
    linked with empty ones. Repeated rows and null ids are placed like any other. By the law ``rows`` shard counts differ by one at
    most; ``slot`` counts a shard's rows from 0, and ``grown_shard`` is null. A text with more copies than a shard holds takes several shards. An
    empty table gives no rows. Only doc_id and text are read.
    """
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_id"),
    ).withColumn("origin", F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(shards)).cast("int"))
    rows = scratch.save(rows, scratch.place("rows"))
    room = [rows.rows // shards + (j < rows.rows % shards) for j in range(shards)]

    cells = rows.df.groupBy("text_id", "origin").agg(F.count(F.lit(1)).alias("n"))
    copies = cells.groupBy("text_id").agg(F.sum("n").alias("copies")).filter(F.col("copies") > 1)
    cells = _propagate(scratch, cells.join(copies, "text_id"), room, rounds)

    placed = rows.df.join(cells.select("text_id", "origin", "shard"), ["text_id", "origin"], "left").select(
        "doc_id", "size", "text_crc32", "text_id",
        F.coalesce("shard", "origin").alias("shard"),
        F.col("shard").isNull().cast("int").alias("alone"),
    )
    # Linked rows first, copies side by side: what stands last in a shard can leave at the least cost.
    ranked = running_rank(scratch, placed, ["shard"], ["alone", "text_id", "doc_id"])
    load = [0] * shards
    for shard, n in ranked.groupBy("shard").agg(F.count(F.lit(1))).collect():
        load[shard] = n
    return _settled(scratch, ranked, load, room).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _settled(scratch: Scratch, ranked: DataFrame, load: list[int], room: list[int]) -> DataFrame:
    """Move the last rows of shards over their room to the free slots of the others."""
    most = F.element_at(F.array(*[F.lit(n).cast("long") for n in room]), F.col("shard") + 1)
    kept = ranked.filter(F.col("rank") < most).withColumn("slot", F.col("rank"))
    # Rows that leave are numbered over all shards: those of the shards before, then by rank.
    left = [max(0, n - r) for n, r in zip(load, room, strict=True)]
    before = [sum(left[:j]) for j in range(len(left))]
    base = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("shard") + 1)
    number = base + F.col("rank") - most
    free, start = [], 0
    for j, (n, r) in enumerate(zip(load, room, strict=True)):
        if n < r:
            free.append((j, start, start + r - n, n))
            start += r - n
    moved = ranked.filter(F.col("rank") >= most).withColumn("_number", number)
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j, low, high, n in free:
        inside = (F.col("_number") >= low) & (F.col("_number") < high)
        shard, slot = F.when(inside, F.lit(j)).otherwise(shard), F.when(inside, F.col("_number") - low + n).otherwise(slot)
    moved = moved.withColumn("slot", slot).withColumn("shard", shard).drop("_number")
    return kept.unionByName(moved.select(*kept.columns))
