from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from heirline.llm import neardup
from heirline.llm.components import components
from heirline.plans.scratch import Scratch


def random_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, words, share):
    return [w if rng.random() > share else "".join(random_words(rng, 1)) for w in words]


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, docs_of, n):
    """Groups of copies with few and with many edits, some of them linked only through others."""
    rng = random.Random(n)
    texts = []
    for size, share in ((40, 0.03), (30, 0.06), (12, 0.12), (6, 0.0)):
        base = random_words(rng, 80)
        texts += [" ".join(edited(rng, base, rng.random() * 2 * share)) for _ in range(size)]
    texts += [" ".join(random_words(rng, rng.randrange(1, 60))) for _ in range(30)]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    got = groups(neardup.near_duplicates(spark, docs_of(docs.items()), n=n))
    assert got == brute.near_duplicates(docs, n, 80)


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two"), (7, "one two"), (7, "one two"), (None, "one two")]
    found = neardup.near_duplicates(spark, docs_of(rows), n=2).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6), (None, 1, None)]
    assert got == sorted(want, key=repr)
    assert neardup.near_duplicates(spark, docs_of([])).collect() == []


def test_long_text(spark, docs_of):
    rng = random.Random(5)
    long = random_words(rng, 30_000)
    found = groups(neardup.near_duplicates(spark, docs_of([(3, " ".join(long)), (9, " ".join(edited(rng, long, 0.02)))])))
    assert found[9][1] == 3 and found[3][0] == 29_996


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    ranks = neardup.superminhash(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), 160)
    assert abs(np.mean(ranks[0] == ranks[1]) - 240 / 360) < 0.12
    assert np.isfinite(ranks).all()
    few = neardup.superminhash(np.array([0, 1, 1]), np.array([7], np.uint64), 16)
    assert sorted(np.floor(few[0]).tolist()) == list(range(16)) and np.isinf(few[1]).all()


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_chains_and_stars(spark, local):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (500, 500)], "a long, b long").repartition(5)
    found = {r.id: r.component for r in components(Scratch(spark), links, local).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)}


def test_query_counts_on_the_smallest_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = entry.queries()["op9_near_duplicates"](spark, folder)
    assert groups(found) == brute.near_duplicates(docs, 2, 80)
    assert found.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
