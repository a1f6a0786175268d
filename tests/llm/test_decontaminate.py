from __future__ import annotations

import random
import re
from collections import Counter

import brute
import numpy as np

from heirline.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(text))


def counted(words, n):
    n = min(n, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute_leaks(docs, items, n=5, percent=80):
    """(doc_id, item_id) -> (best similarity, first start) over all windows of an item's size."""
    best = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            q = words_of(item)
            if not q or not w:
                continue
            size, goal = min(n, len(q)), counted(q, n)
            for s in range(max(1, len(w) - len(q) + 1)):
                part = w[s : s + len(q)]
                own = counted(part, size) if len(part) >= size else counted(part, len(part))
                shared = sum((own & goal).values())
                whole = sum((own | goal).values())
                if shared and 100 * shared >= percent * whole and shared / whole > best.get((d, i), (0, 0))[0]:
                    best[d, i] = (shared / whole, s)
    return best


def test_against_brute_force(spark, docs_of):
    rng = random.Random(2)

    def some(n):
        return ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n)]

    items = [(i, " ".join(some(n))) for i, n in enumerate((1, 3, 5, 6, 15, 15, 25, 40, 60))]
    items += [(20, None), (21, ""), (22, "the cat the cat the cat the cat the cat")]
    docs = []
    for d in range(60):
        text = some(rng.randrange(0, 80))
        for _, item in rng.sample(items, 2):
            part = (item or "").split()
            for _ in range(rng.randrange(0, 3)):
                if len(part) > 12:
                    part[rng.randrange(len(part))] = rng.choice(["zz", "zz yy", ""])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, " ".join(text).upper() if d % 7 == 0 else ", ".join(text)))
    docs += [(100, None), (101, ""), (102, items[7][1][:-6]), (None, items[4][1]), (5, docs[5][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(spark, docs_of(docs), bench).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got} == want
    assert sum(r.doc_id == 5 for r in got) == 2 * sum(d == 5 for d, _ in want)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(spark, docs_of([(1, "a b c d e f")]), none).collect() == []
    assert decontaminate.leaks(spark, docs_of([]), some).collect() == []


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(3)
    own = decontaminate.SizeClass(10, 20, 7)
    for i in range(50):
        own.add(i, rng.integers(0, 2**63, 10, dtype=np.uint64))
    own.close()
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for k in range(150):
        bits = rng.choice(64, rng.integers(0, 24), replace=False)
        prints[k] = own.prints[k % 50] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0))
    got = {tuple(p) for p in own.near(prints).tolist()}
    apart = np.bitwise_count(prints[:, None] ^ own.prints[None, :])
    assert got == {tuple(p) for p in np.argwhere(apart <= 20).tolist()}


def test_parts_and_very_long_texts(spark, docs_of, monkeypatch):
    """A benchmark in several parts finds the same; sums of a long text are held for some places only."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))) for i in range(6)]
    long = " ".join([items[0][1], *(f"v{rng.randrange(10**9)}" for _ in range(150_000)), items[0][1], items[5][1]])
    docs = docs_of([(1, long), (2, items[3][1]), (3, "nothing")])
    table = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    plain = decontaminate.signs
    monkeypatch.setattr(decontaminate, "signs", lambda h: seen.append(len(h)) or plain(h))
    index = decontaminate.ItemIndex(items, 5, 80, decontaminate.RADIUS, decontaminate.BLOCKS)
    assert [(i, s) for _, i, s, *_ in index.search(decontaminate.pa.array([long]))] == [(0, 0), (5, 150_060)]
    assert max(seen) <= decontaminate.PLACES + 60
    monkeypatch.setattr(decontaminate, "signs", plain)
    want = {(1, 0, 0), (1, 5, 150_060), (2, 3, 0)}
    for size in (4 << 20, 500, 1):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
        monkeypatch.setattr(decontaminate.item_parts, "__defaults__", (size,))
        assert {(r.doc_id, r.item_id, r.start_word) for r in decontaminate.leaks(spark, docs, table).collect()} == want
