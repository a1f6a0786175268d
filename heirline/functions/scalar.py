"""Column expressions; all of them stay inside Spark's built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from heirline.schema import OTHER_RANK, RISK_LEVELS, SAFE_LEVEL, TYPE_RANK


def clamp_weight(weight: Column) -> Column:
    """Weight limited to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def content_of(**pairs: object) -> Column:
    """MAP<STRING,STRING> literal from key/value pairs, values rendered as text."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    cells = []
    for key, value in pairs.items():
        cells += [F.lit(key), F.lit(value).cast("string")]
    return F.create_map(*cells)


def content_text(content: Column) -> Column:
    """``k=v;`` for every entry, keys ascending; a null value reads ``null``."""
    entries = F.array_sort(F.map_entries(content))
    cells = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")), F.lit(";")),
    )
    return F.coalesce(F.concat_ws("", cells), F.lit(""))


def own_payload(node_id: Column, node_type: Column, creator: Column, content: Column) -> Column:
    """The part of the hashed text that depends on the artifact alone."""
    return F.concat(
        F.lit("nodeId="), node_id,
        F.lit(";nodeType="), node_type,
        F.lit(";creator="), creator,
        F.lit(";"), content_text(content),
    )


def parent_payload(hashes: Column, packed: bool = False) -> Column:
    """``parent=h;`` for every hash of the list, ascending; empty for no parents. ``packed`` hashes are bytes, sorted as such: their digits are in the same order."""
    # Unlike array_sort, sort_array compares without a lambda.
    ordered = F.sort_array(hashes)
    joined = F.array_join(F.transform(ordered, hex_text) if packed else ordered, ";parent=")
    return F.when(F.size(hashes) > 0, F.concat(F.lit("parent="), joined, F.lit(";"))).otherwise("")


def sha256_hex(text: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


def hex_text(digest: Column) -> Column:
    """Lower-case digits of the bytes of a hash."""
    return F.lower(F.hex(digest))


def risk_level(score: Column) -> Column:
    """Name of the risk band; the last band is open at its lower bound."""
    *closed, (last, floor) = RISK_LEVELS
    start = F.when(F.isnull(score), F.lit(SAFE_LEVEL))
    banded = reduce(lambda c, b: c.when(score >= b[1], F.lit(b[0])), closed, start)
    return banded.when(score > floor, F.lit(last)).otherwise(F.lit(SAFE_LEVEL))


def type_rank(node_type: Column) -> Column:
    """Sort key of a type in impact listings."""
    first, *rest = TYPE_RANK.items()
    start = F.when(node_type == first[0], F.lit(first[1]))
    return reduce(lambda c, t: c.when(node_type == t[0], F.lit(t[1])), rest, start).otherwise(OTHER_RANK)


def round4(value: Column) -> Column:
    """Half-up rounding to four places, as risk summaries show it."""
    return F.round(value, 4)
