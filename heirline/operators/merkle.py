"""Chained content hashes: computing, comparing, proving."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirline.functions.scalar import hex_text, own_payload, parent_payload, sha256_hex
from heirline.operators.reach import many, reached
from heirline.plans.adjacency import hot_limit
from heirline.plans.bitmaps import BITS, WORD_NAMES, Closure, closure, is_set
from heirline.plans.frontier import neighbours
from heirline.plans.prefix import running_total
from heirline.plans.scratch import Scratch
from heirline.plans.sweep import gathered, sweep, with_parent_values
from heirline.plans.tail import tail_pass

HUB_CHUNK = 100_000
# Parent ids in one row of a listing.
LIST_ROWS = 10_000


def own_payloads(nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, own): the artifact's own part of the hashed text."""
    own = own_payload(F.col("node_id"), F.col("node_type"), F.col("creator"), F.col("content"))
    return nodes.select("node_id", "node_type", own.alias("own"))


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feed the ordered chunks of each vertex to one running digest."""
    current, digest = None, None
    for batch in batches:
        out = []
        for node_id, chunk in zip(batch["node_id"], batch["chunk"], strict=True):
            if node_id != current:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = node_id, hashlib.sha256()
            digest.update(chunk.encode("utf-8"))
        yield pd.DataFrame(out, columns=["node_id", "hash"])
    if digest is not None:
        yield pd.DataFrame([(current, digest.hexdigest())], columns=["node_id", "hash"])


def hub_hashes(own: DataFrame, parents: DataFrame, links: int) -> DataFrame:
    """(node_id, hash) of vertices with too many parents for one row.

    ``parents`` holds (node_id, parent_hash). Sorting and joining the text happens in
    ranges of about ``HUB_CHUNK`` hashes over the whole cluster. Only the digest itself
    runs in order, chunk by chunk, since SHA-256 cannot be split; no task holds more
    than one chunk of a vertex at a time.
    """
    ranges = max(1, -(-links // HUB_CHUNK))
    ranged = parents.repartitionByRange(ranges, "node_id", "parent_hash").withColumn("part", F.spark_partition_id())
    text = parent_payload(F.collect_list("parent_hash"))
    chunks = ranged.groupBy("node_id", "part").agg(text.alias("chunk"))
    heads = own.select("node_id", F.lit(-1).alias("part"), F.col("own").alias("chunk"))
    ordered = heads.unionByName(chunks).repartition("node_id").sortWithinPartitions("node_id", "part")
    return ordered.mapInPandas(_stream_digests, "node_id string, hash string")


def hash_from_parents(own: DataFrame, parents: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(node_id, hash) from own payloads and (node_id, parent_hash) rows.

    A hash goes as bytes where ``parent_hash`` is binary: half of what its digits take in a shuffle. Vertices in ``hubs`` go through :func:`hub_hashes`; for the others the sorted
    parent list fits in a row.
    """

    def plain(own_rows: DataFrame, parent_rows: DataFrame) -> DataFrame:
        hashes = F.collect_list("parent_hash")
        lists = parent_rows.groupBy("node_id").agg(parent_payload(hashes, packed).alias("_above"))
        text = F.concat("own", F.coalesce("_above", F.lit("")))
        return own_rows.join(lists, "node_id", "left").select("node_id", sha256_hex(text).alias("hash"))

    packed = isinstance(parents.schema["parent_hash"].dataType, T.BinaryType)
    if hubs is None:
        return plain(own, parents)
    big = F.broadcast(hubs.select("node_id"))
    light = plain(own.join(big, "node_id", "left_anti"), parents.join(big, "node_id", "left_anti"))
    # The ranges are sized by the links of these hubs, not by those of the whole graph.
    above = parents.join(big, "node_id", "left_semi")
    if packed:
        above = above.withColumn("parent_hash", hex_text(F.col("parent_hash")))
    heavy = hub_hashes(own.join(big, "node_id", "left_semi"), above, above.count())
    return light.unionByName(heavy)


def _handed_down(parent_hash: str, _: float) -> str:
    return parent_hash


def _digest(own: str, parent_hashes: list[str]) -> str:
    text = own + "".join(f"parent={h};" for h in sorted(parent_hashes))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def hash_chain(graph, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, hash) of every artifact.

    ``nodes`` replaces the stored artifacts, for instance with edited content, on the
    same edges.
    """
    own = own_payloads(graph.nodes if nodes is None else nodes).drop("node_type").join(graph.round_of, "node_id")
    stored = graph.scratch.save(gathered(own, "layer", graph.rounds), graph.scratch.place("own"), partition_by=("layer",))

    def of_layer(layer: int) -> DataFrame:
        return graph.scratch.read(stored.path, stored.df.schema, f"layer={layer}").drop("layer")

    def step(layer: int, edges: DataFrame, finished: DataFrame) -> DataFrame:
        joined = with_parent_values(graph, edges, finished.withColumn("hash", F.unhex("hash")))
        parents = joined.select(F.col("dst").alias("node_id"), F.col("hash").alias("parent_hash"))
        return hash_from_parents(of_layer(layer), parents, graph.hot_targets)

    def last(edges: DataFrame, finished: DataFrame) -> DataFrame:
        joined = with_parent_values(graph, edges, finished)
        above = joined.select(F.col("dst").alias("node_id"), F.col("hash").alias("value"))
        values = tail_pass(graph, of_layer(-1), edges, above, _handed_down, _digest, "string")
        return values.withColumnRenamed("value", "hash")

    roots = of_layer(0).select("node_id", sha256_hex(F.col("own")).alias("hash"))
    return sweep(graph, "hashes", roots, step, last)


def listed_parents(scratch: Scratch, links: DataFrame, keys: list[str], size: int = LIST_ROWS) -> DataFrame:
    """(keys, part, parents) from (keys, parent_id): the ids ascending, at most ``size`` in a row.

    Part 0 holds the first ``size`` ids, part 1 the next, and so on, so the rows depend on the ids alone.
    """
    placed = running_total(scratch, links, ["parent_id"], F.lit(1), "_place", keys)
    part = F.floor(F.col("_place") / size).cast("int").alias("part")
    return placed.groupBy(*keys, part).agg(F.array_sort(F.collect_list("parent_id")).alias("parents"))


def parent_lists(graph, size: int = LIST_ROWS) -> DataFrame:
    """(node_id, part, parents) with ids ascending, at most ``size`` in a row; no row for a root."""
    links = graph.edges.select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"))
    return listed_parents(graph.scratch, links, ["node_id"], size)


def detect_tampering(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """(node_id, expected, current, tampered) per row of ``expected`` (node_id, hash).

    An unknown or unhashed artifact does not count as tampered.
    """
    current = hashes.select("node_id", F.col("hash").alias("current"))
    return (
        expected.select("node_id", F.col("hash").alias("expected"))
        .join(current, "node_id", "left")
        .withColumn("tampered", F.col("current").isNotNull() & ~F.col("current").eqNullSafe(F.col("expected")))
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, before, after, state) with unchanged, changed, added or removed."""
    left = before.select("node_id", F.col("hash").alias("before"))
    right = after.select("node_id", F.col("hash").alias("after"))
    state = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") == F.col("after"), "unchanged")
        .otherwise("changed")
    )
    return left.join(right, "node_id", "full_outer").withColumn("state", state)


class Proof:
    """Evidence for the hashes of one or more targets.

    ``entries`` (proof_id, node_id, node_type, own, hash): the target, whose id is also
    the proof id, and all its ancestors. ``links`` (proof_id, node_id, parent_id): the
    parents of every entry. Both are plain tables that may be written and read again.
    """

    def __init__(self, entries: DataFrame, links: DataFrame, scratch: Scratch | None = None):
        self.entries = entries
        self.links = links
        self.scratch = scratch or Scratch(entries.sparkSession)

    def targets(self) -> DataFrame:
        """(target, target_hash, chain_length) per proof."""
        own_row = F.col("node_id") == F.col("proof_id")
        return self.entries.groupBy(F.col("proof_id").alias("target")).agg(
            F.max(F.when(own_row, F.col("hash"))).alias("target_hash"),
            F.count(F.lit(1)).alias("chain_length"),
        )

    def chain(self) -> DataFrame:
        """(proof_id, node_id, part, node_type, own, hash, parents) with parent ids ascending.

        As in :func:`parent_lists`, an entry with very many parents has several parts.
        """
        lists = listed_parents(self.scratch, self.links, ["proof_id", "node_id"])
        none = F.array().cast("array<string>")
        return self.entries.join(lists, ["proof_id", "node_id"], "left").select(
            "proof_id", "node_id", F.coalesce("part", F.lit(0)).alias("part"), "node_type", "own", "hash",
            F.coalesce("parents", none).alias("parents"),
        )


class SweptProof(Proof):
    """Proofs of many targets, out of one sweep.

    What a proof says about an artifact does not depend on the target. So the statements (``facts``: node_id, node_type, own, hash; ``above``: node_id,
    parent_id) are kept once, and bitmaps (``members``) tell which proofs hold an artifact. ``entries`` and ``links`` are the same tables as those
    of any proof, made when they are read.
    """

    def __init__(self, graph, members: Closure):
        self.graph = graph
        self.members = members
        self.scratch = graph.scratch
        self.facts = own_payloads(graph.nodes).join(graph.hashes.select("node_id", "hash"), "node_id")
        self.above = graph.edges.select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"))

    def _of_proofs(self, rows: DataFrame) -> DataFrame:
        """Rows (node_id, ...) once for every proof that holds the artifact."""
        return self.members.listed(rows, None).withColumnRenamed("query_id", "proof_id")

    @cached_property
    def entries(self) -> DataFrame:
        return self._of_proofs(self.facts)

    @cached_property
    def links(self) -> DataFrame:
        return self._of_proofs(self.above)

    def targets(self) -> DataFrame:
        lengths = self.members.counts(self.facts.select("node_id", F.lit("").alias("kind"))).select("query_id", F.col("n").alias("chain_length"))
        stated = self.facts.join(self.members.starts.select(F.col("query_id").alias("node_id")), "node_id")
        stated = stated.groupBy(F.col("node_id").alias("query_id")).agg(F.max("hash").alias("target_hash"))
        return lengths.join(stated, "query_id", "left").select(F.col("query_id").alias("target"), "target_hash", "chain_length")

    def chain(self) -> DataFrame:
        none = F.array().cast("array<string>")
        rows = self.facts.join(listed_parents(self.scratch, self.above, ["node_id"]), "node_id", "left")
        rows = rows.select("node_id", F.coalesce("part", F.lit(0)).alias("part"), "node_type", "own", "hash", F.coalesce("parents", none).alias("parents"))
        return self._of_proofs(rows)


def prove(graph, targets: DataFrame) -> Proof:
    """Proofs for the ids in ``targets`` (node_id), all in one backward walk, or one sweep if they are many."""
    scratch = graph.scratch
    known = targets.select("node_id").distinct().join(graph.nodes.select("node_id"), "node_id", "left_semi")
    own = scratch.save(known.select(F.col("node_id").alias("query_id"), "node_id"), scratch.place("proof-targets")).df
    if many(graph, own):
        return SweptProof(graph, closure(graph, own, "backward").with_starts())
    # The walk and the links need this layout; made before the hashes, it serves their sweep, too.
    _ = graph.backward
    facts = own_payloads(graph.nodes).join(graph.hashes.select("node_id", "hash"), "node_id")
    rows = reached(graph, own, "backward").drop("hops").unionByName(own).select(F.col("query_id").alias("proof_id"), "node_id")
    stood = scratch.save(rows, scratch.place("proof-members"))
    columns = ["proof_id", "node_id", "node_type", "own", "hash"]
    entries = scratch.save(stood.df.join(facts, "node_id").select(*columns), scratch.place("proof-entries"))
    links = neighbours(graph, stood, "backward", stood.rows).select(
        "proof_id", F.col("_at").alias("node_id"), F.col("node_id").alias("parent_id")
    )
    stored = scratch.save(links, scratch.place("proof-links"))
    return Proof(entries.df, stored.df, scratch)


def _hubs(links: DataFrame, key: list, hub_parents: int) -> DataFrame | None:
    """(node_id) of entries with too many parents for one row, named by ``key``; None without any."""
    counts = links.groupBy(*key).count()
    stats = counts.agg(F.max("count").alias("top"), F.sum("count").alias("links")).first()
    limit = hot_limit(stats.links or 0, hub_parents)
    return counts.filter(F.col("count") > limit).drop("count") if (stats.top or 0) > limit else None


def _verify_swept(proof: SweptProof, nodes: DataFrame | None, hub_parents: int) -> DataFrame:
    """The verdicts of :func:`verify`: every statement is checked once, and what fails is told to the proofs that hold it by their bits.

    A bit that a parent lacks and its child has is a hole in that proof.
    """
    merged = [F.bit_or(w).alias(w) for w in WORD_NAMES]
    held, facts = proof.members.reached, proof.facts
    inside = held.select("node_id").distinct()
    stated = facts.join(inside, "node_id", "left_semi")
    if nodes is not None:
        live = own_payloads(nodes).select("node_id", F.col("own").alias("_live"))
        stated = stated.join(live, "node_id", "left").withColumn("own", F.col("_live")).drop("_live")
    known = facts.select(F.col("node_id").alias("parent_id"), F.unhex("hash").alias("parent_hash"))
    links = proof.above.join(inside, "node_id", "left_semi")
    joined = links.join(known, "parent_id", "left").select("node_id", "parent_hash")
    computed = hash_from_parents(stated.select("node_id", "own"), joined, _hubs(links, ["node_id"], hub_parents)).withColumnRenamed("hash", "_computed")
    fits = F.coalesce(F.col("hash") == F.col("_computed"), F.lit(False))
    wrong = stated.join(computed, "node_id", "left").filter(~fits).select("node_id")
    wrong = wrong.unionByName(joined.filter(F.col("parent_hash").isNull()).select("node_id")).distinct()

    needed = proof.graph.by_target.meet(held).groupBy(F.col("far").alias("node_id"), "block").agg(*merged)
    have = held.groupBy("node_id", "block").agg(*[F.bit_or(w).alias(f"_{w}") for w in WORD_NAMES])
    lacking = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in WORD_NAMES]
    holes = needed.join(have, ["node_id", "block"], "left").select("block", *lacking)
    marked = held.join(wrong, "node_id").select("block", *WORD_NAMES).unionByName(holes)
    # A row for each block of proofs.
    marked = marked.groupBy("block").agg(*merged).select("block", F.array(*WORD_NAMES).alias("_marked"))

    starts = proof.members.starts.withColumn("block", F.floor(F.col("number") / BITS))
    mine = held.select(F.col("node_id").alias("query_id"), "block", F.array(*WORD_NAMES).alias("_words"))
    there = starts.join(mine, ["query_id", "block"]).filter(is_set("_words")).select("query_id", F.lit(True).alias("_target"))
    there = there.join(facts.select(F.col("node_id").alias("query_id")), "query_id", "left_semi").distinct()
    proofs = starts.join(marked, "block", "left").join(there, "query_id", "left")
    return _verdicts(proofs.select(F.col("query_id").alias("proof_id"), (F.col("_target").isNotNull() & ~is_set("_marked")).alias("valid")))


def _verdicts(rows: DataFrame) -> DataFrame:
    """(target, valid, message) from (proof_id, valid)."""
    return rows.select(
        F.col("proof_id").alias("target"),
        "valid",
        F.when(F.col("valid"), "Integrity confirmed").otherwise("TAMPER DETECTED!").alias("message"),
    )


def verify(proof: Proof, nodes: DataFrame | None = None, hub_parents: int = 200_000) -> DataFrame:
    """(target, valid, message) per proof.

    A proof holds if every entry's hash follows from its own text and the stored hashes
    of its parents. Taken over all entries, roots first, that is the same as computing
    the chain anew, so one pass without rounds is enough. With ``nodes`` the own text is
    taken from those artifacts instead, which tells whether the catalog still matches.
    """
    if isinstance(proof, SweptProof):
        return _verify_swept(proof, nodes, hub_parents)
    keys = ["proof_id", "node_id"]
    entries = proof.entries
    if nodes is not None:
        live = own_payloads(nodes).select("node_id", F.col("own").alias("_live"))
        entries = entries.join(live, "node_id", "left").withColumn("own", F.col("_live")).drop("_live")
    known = entries.select("proof_id", F.col("node_id").alias("parent_id"), F.col("hash").alias("parent_hash"))
    joined = proof.links.join(known, ["proof_id", "parent_id"], "left")
    ident = F.to_json(F.struct(*keys))

    hubs = _hubs(proof.links, keys, hub_parents)
    computed = hash_from_parents(
        entries.select(ident.alias("node_id"), "own"),
        joined.select(ident.alias("node_id"), "parent_hash"),
        None if hubs is None else hubs.select(ident.alias("node_id")),
    ).withColumnRenamed("hash", "_computed")

    holes = joined.filter(F.col("parent_hash").isNull()).select("proof_id").distinct().withColumn("_hole", F.lit(True))
    rows = entries.withColumn("_ident", ident).join(computed.withColumnRenamed("node_id", "_ident"), "_ident", "left")
    fits = F.coalesce(F.col("hash") == F.col("_computed"), F.lit(False))
    verdicts = rows.groupBy("proof_id").agg(
        F.min(fits).alias("_fits"), F.max(F.col("node_id") == F.col("proof_id")).alias("_target")
    )
    valid = F.col("_fits") & F.col("_target") & F.col("_hole").isNull()
    return _verdicts(verdicts.join(holes, "proof_id", "left").select("proof_id", valid.alias("valid")))
