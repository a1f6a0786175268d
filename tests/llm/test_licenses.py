from __future__ import annotations

import random
import re

import brute
import numpy as np

from heirline.llm import licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(text))


def base_of(words):
    found = []
    for phrase, label in licenses.BASE.items():
        q = phrase.split()
        found += [(k, label) for k in range(len(words) - len(q) + 1) if words[k : k + len(q)] == q]
    return found


def test_base_phrases_against_brute_force(spark, docs_of):
    rng = random.Random(1)
    parts = ["cc", "by", "CC BY", "cc-by", "general", "public", "license", "General Public License", "all rights reserved", "rights", "été", "x1", "!"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "cc by " * 3000), (None, "cc by"), (503, "accby ccby"), (3, docs[3][1])]
    got = licenses.scan_licenses(spark, docs_of(docs)).collect()
    assert len(got) == len(docs)
    text_of = dict(docs)
    for r in got:
        words = words_of(text_of[r.doc_id])
        base = base_of(words)
        starts = [k for k, _ in base]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(base)
    assert licenses.scan_licenses(spark, docs_of([])).collect() == []


def placed_by_brute_force(words, template, weight):
    """The best part of a template's weight that stands in place around its key."""
    q, key = template.text.split(), template.key.split()
    at = next(i for i in range(len(q)) if q[i : i + len(key)] == key)
    best = 0.0
    for s in range(-len(q), len(words)):
        if words[max(0, s + at) : s + at + len(key)] == key and s + at >= 0:
            inside = sum(weight[w] for i, w in enumerate(q) if 0 <= s + i < len(words) and words[s + i] == w)
            best = max(best, inside / sum(weight[w] for w in q))
    return best


def test_templates_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        t = rng.choice(licenses.TEMPLATES)
        words = [w if rng.random() > 0.15 else "zzz" for w in t.text.split()]
        docs.append((i, " ".join(["start"] * rng.randrange(4) + words + ["end"] * rng.randrange(4))))
    vocabulary = sorted({w for t in [*licenses.BASE, *(t.text for t in licenses.TEMPLATES)] for w in t.split()})
    holders, total = licenses.holders_of(docs_of(docs).select("text"), vocabulary)
    assert total == len(docs)
    assert holders == {w: sum(w in words_of(text) for _, text in docs) for w in vocabulary}
    index = licenses.TokenIndex(licenses.BASE, licenses.TEMPLATES, holders, total)
    weight = dict(zip(index.vocabulary, index.idf.tolist(), strict=True))
    text_of = dict(docs)
    for r in licenses.scan_licenses(spark, docs_of(docs)).collect():
        words = words_of(text_of[r.doc_id])
        want = {label for _, label in base_of(words)}
        want |= {t.label for t in licenses.TEMPLATES if placed_by_brute_force(words, t, weight) >= licenses.LEAST_SCORE}
        assert set(filter(None, r.labels.split(","))) == want


def test_work_depends_on_shared_rare_words(spark):
    """A text proposes starts only of templates whose rare words it holds; of few holders, words are rare."""
    holders = {w: 1000 for t in licenses.TEMPLATES for w in t.text.split()} | {"mozilla": 1, "unencumbered": 1}
    index = licenses.TokenIndex(licenses.BASE, licenses.TEMPLATES, holders, 2000)
    for e in index.entries:
        rare = e.rare()
        # Without its rare words no placement is good enough.
        assert e.weight.sum() - e.weight[rare].sum() < e.least + 1e-9 and (e.base or len(rare) < len(e.words))
    words = "the terms of the mozilla public license v 2 0".split()
    numbers = index.numbers(np.array([licenses.W.word_hash(w) for w in words], np.uint64))
    found = index.scan(numbers, np.array([0, len(words)]))
    assert {e.label for e, *_ in found[0]} == {"mpl-2.0"} and found[0][0][1] == -2
    assert index.scan(np.full(5, -1), np.array([0, 5])) == {}


def test_long_templates_with_edits(spark, docs_of):
    """Several notices in one long text, cut off at either end."""
    rng = random.Random(5)
    for_text = [t for t in licenses.TEMPLATES if len(t.text.split()) > 15]
    docs = []
    for i in range(60):
        words = ["filler"] * rng.randrange(30)
        for t in rng.sample(for_text, 3):
            q = t.text.split()
            words += [w if rng.random() > 0.1 else "zzz" for w in q[rng.randrange(3) : len(q) - rng.randrange(3)]] + ["filler"] * rng.randrange(40)
        docs.append((i, " ".join(words)))
    docs.append((100, "filler " * 200_000 + for_text[0].text))
    vocabulary = sorted({w for t in [*licenses.BASE, *(t.text for t in licenses.TEMPLATES)] for w in t.split()})
    index = licenses.TokenIndex(licenses.BASE, licenses.TEMPLATES, *licenses.holders_of(docs_of(docs).select("text"), vocabulary))
    weight = dict(zip(index.vocabulary, index.idf.tolist(), strict=True))
    text_of = dict(docs)
    got = {r.doc_id: r for r in licenses.scan_licenses(spark, docs_of(docs)).collect()}
    assert got[100].labels == for_text[0].label and got[100].spans[0].start == 200_000
    for d in range(60):
        words = words_of(text_of[d])
        want = {label for _, label in base_of(words)}
        want |= {t.label for t in licenses.TEMPLATES if placed_by_brute_force(words, t, weight) >= licenses.LEAST_SCORE}
        assert set(filter(None, got[d].labels.split(","))) == want
