from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from heirline.llm import shards


def check_shards(rows, docs, count):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(count)]
    assert set(slots) <= set(range(count)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text_of = dict(docs)
    for r in rows:
        raw = (text_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    where = defaultdict(set)
    for r in rows:
        where[text_of[r.doc_id] or ""].add(r.shard)
    return where


def test_small_groups_stay_together(spark, docs_of):
    docs = [(i, f"é text {i}") for i in range(300)] + [(1000 + i, f"group {i % 40}") for i in range(120)]
    where = check_shards(shards.assign_shards(spark, docs_of(docs), shards=6).collect(), docs, 6)
    assert all(len(s) == 1 for t, s in where.items() if t.startswith("group"))


@pytest.mark.parametrize("copies", [100, 250])
def test_a_third_and_more_of_all_rows_are_copies(spark, docs_of, copies):
    docs = [(i, f"text {i}") for i in range(200)] + [(1000 + i, "same") for i in range(copies)]
    docs += [(5000 + i, f"pair {i // 2}") for i in range(60)]
    where = check_shards(shards.assign_shards(spark, docs_of(docs), shards=8).collect(), docs, 8)
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("pair")) <= 6
    assert len(where["same"]) < 8


def test_all_rows_are_copies(spark, docs_of):
    docs = [(i, "same") for i in range(50)]
    check_shards(shards.assign_shards(spark, docs_of(docs), shards=24).collect(), docs, 24)


def test_edge_cases(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "x" * 200_000), (4, "a"), (4, "a"), (None, "b"), (None, "b")]
    rows = shards.assign_shards(spark, docs_of(docs), shards=3).collect()
    where = check_shards(rows, docs, 3)
    assert len(where[""]) == 1 and len(rows) == 7
    assert shards.assign_shards(spark, docs_of([])).collect() == []
