from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heirline.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = entry.queries()["op1_quality"](spark, FOLDER).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in held]
    assert np.mean(right) >= 0.95
    assert all(r.predicted == 1 for r in held if labels[r.doc_id] == 1)


def test_edge_cases(spark, docs_of):
    texts = [(i, f"good word {i} fine text") for i in range(30)] + [(100 + i, f"bad!! {i}!! junk!!") for i in range(30)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 1), (5, 1), (6, None), (7, 9), (999, 0)]
    docs = docs_of([*texts, (500, None), (501, ""), (None, "good word"), (5, texts[5][1]), (502, "good fine " * 50_000)])
    weights = quality.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    scored = quality.score(spark, docs.drop("score"), weights).collect()
    by = {r.doc_id: r.score for r in scored}
    assert len(scored) == 65 and all(0 <= r.score <= 1 for r in scored)
    assert min(by[i] for i in range(30)) > 0.5 > max(by[100 + i] for i in range(30))
    assert by[500] == by[501] and by[502] > 0.5


def test_nothing_to_learn_from(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, label int")
    weights = quality.train(docs_of([(1, "a")]), none)
    assert not weights.any()
    assert [r.s for r in quality.score(spark, docs_of([(1, "a")]), weights, "s").collect()] == [0.5]
    assert quality.score(spark, docs_of([]), weights, "s").collect() == []


def test_features_are_unit_vectors():
    first, slot, value = quality.features(pa.array(["a a b", None, "x!!"]), 1 << 12)
    assert first[1] == first[2] and len(slot) == len(value) == first[-1]
    for a, b in ((first[0], first[1]), (first[2], first[3])):
        assert abs((value[a:b] ** 2).sum() - 1) < 1e-5 and (np.diff(slot[a:b]) > 0).all()


def test_repeated_words_share_a_feature():
    _, one, _ = quality.features(pa.array(["q q q"]), 1 << 18)
    _, other, _ = quality.features(pa.array(["z z z"]), 1 << 18)
    assert len(set(one.tolist()) & set(other.tolist())) == 1


def plain_features(text):
    """Words and pairs of neighbours with their weights, as a vector of length 1."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")
    pairs = [("again",) if a == b else (a, b) for a, b in zip(words[:-1], words[1:], strict=True)]
    # A text of one word has it as its pair as well.
    counts = Counter(words) + Counter(pairs) + (Counter(words) if len(words) == 1 else Counter())
    length = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    return {f: math.log1p(n) / length for f, n in counts.items()}


def plain_training(rows, rule):
    """FTRL-Proximal, one weight at a time; rows: (features, label) in order."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if abs(z[f]) <= rule.l1:
            return 0.0
        return (math.copysign(rule.l1, z[f]) - z[f]) / ((rule.beta + math.sqrt(n[f])) / rule.alpha + rule.l2)

    for turn in range(rule.passes):
        for k in np.random.default_rng(turn).permutation(len(rows)).tolist():
            vector, label = rows[k]
            vector = vector | {None: 1.0}
            w = {f: weight(f) for f in vector}
            error = 1 / (1 + math.exp(-sum(w[f] * x for f, x in vector.items()))) - label
            for f, x in vector.items():
                g = error * x
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / rule.alpha * w[f]
                n[f] += g * g
    return weight


def test_against_plain_python(spark, docs_of):
    """Weights and scores of a small corpus equal those of the rule written out word by word."""
    rng = random.Random(17)
    vocabulary = ["good", "Bad", "été", "x1", "!!", ",", "the", "the", "of"]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for i in range(120)}
    labels = {i: int(texts[i].count("good") > texts[i].count("Bad")) for i in range(0, 120, 2)}
    docs = docs_of(texts.items())
    weights = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"))
    weight = plain_training([(plain_features(texts[i]), labels[i]) for i in sorted(labels)], quality.Rule())
    for r in quality.score(spark, docs.drop("score"), weights).collect():
        margin = sum(weight(f) * x for f, x in plain_features(texts[r.doc_id]).items()) + weight(None)
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4)
