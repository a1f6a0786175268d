"""License scans: a positional index of rare tokens.

The templates are notices and sentences of license texts, each with a label and a key phrase. The index is inverted: it holds
for a word the templates and places where it stands. Of each template only the rarest words are posted, as many as carry more weight
than a placement may lack, so whatever stands well enough in a document holds one of them. The rare license words of a document are looked up;
every posting proposes a start of its template, and starts that agree are intersected by relative position. Where the posted words
in place leave enough weight possible, the whole template is compared and the key phrase verified, word for word. A document does no work for templates
of which it holds no rare word. Rarity is counted over all documents, in a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import words as W

# Phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """``key`` must stand word for word for the label to hold; it is a part of ``text``."""

    label: str
    text: str
    key: str


# Notices and sentences of license texts, as words, with the phrase that tells each of them apart (fixed values).
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    Template(
        "mit",
        "and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "to deal in the software without restriction",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "except in compliance with the license",
    ),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing",
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template(
        "gpl-3.0",
        "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
        "free software foundation either version 3",
    ),
    Template(
        "gpl-2.0",
        "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license "
        "or at your option any later version",
        "free software foundation either version 2",
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "gnu lesser general public license",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions of source code must retain",
    ),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "redistributions in binary form must reproduce",
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    Template("public-domain", "dedicated to the public domain", "public domain"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software",
        "free and unencumbered software",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software",
        "in no event will the authors be held liable",
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license",
        "person or organization obtaining a copy",
    ),
)
# Part of a template's weight that must stand in place for its label.
LEAST_SCORE = 0.6
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:long,score:double>>"
)


@dataclass
class _Entry:
    """A template or base phrase as word numbers, its key's place, the weight of its words and the least that must stand in place."""

    label: str
    words: np.ndarray
    key: slice
    base: bool
    weight: np.ndarray
    least: float

    def rare(self) -> np.ndarray:
        """The places of the rarest words, as many as carry more weight than may be missing. Equal weights go by place."""
        order = np.argsort(-self.weight, kind="stable")
        missing = 1 - self.least
        return order[: int(np.searchsorted(np.cumsum(self.weight[order]), missing + 1e-9)) + 1]


class TokenIndex:
    """Postings (template, place) of the rare words of all templates."""

    def __init__(self, base: dict[str, str], templates: tuple[Template, ...], holders: dict[str, int], documents: int):
        split = {t: t.split() for t in [*base, *(t.text for t in templates)]}
        self.vocabulary = sorted({w for words in split.values() for w in words})
        self.hashes = np.array([W.word_hash(w) for w in self.vocabulary], np.uint64)
        self.order = np.argsort(self.hashes)
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.idf = np.array([math.log((1 + documents) / (1 + holders.get(w, 0))) + 1 for w in self.vocabulary])
        self.entries = [self._entry(number, p, p, label, True) for p, label in base.items()]
        self.entries += [self._entry(number, t.text, t.key, t.label, False) for t in templates]
        posted = sorted((int(e.words[place]), t, place) for t, e in enumerate(self.entries) for place in e.rare().tolist())
        words, self.template, self.place = (np.array(c, np.int64) for c in zip(*posted, strict=True))
        self.begin = np.searchsorted(words, np.arange(len(self.vocabulary) + 1))
        self.posted_weight = np.array([self.entries[t].weight[p] for t, p in zip(self.template, self.place, strict=True)])
        # What the words that are not posted can add at most, less what must stand in place.
        self.spare = np.array([1 - e.weight[e.rare()].sum() - e.least for e in self.entries])

    def _entry(self, number: dict[str, int], text: str, key: str, label: str, base: bool) -> _Entry:
        words, inside = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(inside)] == inside)
        numbers = np.array([number[w] for w in words])
        weight = self.idf[numbers]
        return _Entry(label, numbers, slice(at, at + len(inside)), base, weight / weight.sum(), 1.0 if base else LEAST_SCORE)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 for others."""
        place = np.minimum(np.searchsorted(self.hashes[self.order], hashes), len(self.order) - 1)
        found = self.order[place]
        return np.where(self.hashes[found] == hashes, found, -1)

    def scan(self, numbers: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[_Entry, int, float]]]:
        """Per text (entry, start, score) wherever a base phrase stands, or a template with its key; start from 0.

        ``first[i]:first[i + 1]`` are the words of text i.
        """
        at = np.flatnonzero(numbers >= 0)
        posted = self.begin[numbers[at] + 1] - self.begin[numbers[at]]
        at, posted = at[posted > 0], posted[posted > 0]
        if not len(at):
            return {}
        post = np.repeat(self.begin[numbers[at]] - np.cumsum(posted) + posted, posted) + np.arange(posted.sum())
        at = np.repeat(at, posted)
        text = np.searchsorted(first, at, "right") - 1
        template, start = self.template[post], at - self.place[post]
        # Postings that propose the same start.
        order = np.lexsort((start, text, template))
        template, text, start, weight = template[order], text[order], start[order], self.posted_weight[post][order]
        new = np.flatnonzero(np.r_[True, (template[1:] != template[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])])
        weight = np.add.reduceat(weight, new)
        template, text, start = template[new], text[new], start[new]
        maybe = weight + self.spare[template] >= -1e-9
        template, text, start = template[maybe], text[maybe], start[maybe]
        found: dict[int, list] = {}
        for t in np.unique(template).tolist():
            entry, mine = self.entries[t], template == t
            texts, starts = text[mine], start[mine]
            places = starts[:, None] + np.arange(len(entry.words))[None, :]
            inside = (places >= first[texts][:, None]) & (places < first[texts + 1][:, None])
            same = inside & (numbers[np.clip(places, 0, len(numbers) - 1)] == entry.words[None, :])
            score = (same * entry.weight).sum(axis=1)
            good = same[:, entry.key].all(axis=1) & (score >= (0.0 if entry.base else entry.least))
            for i, s, x in zip(texts[good].tolist(), (starts - first[texts])[good].tolist(), score[good].tolist(), strict=True):
                found.setdefault(i, []).append((entry, s, round(min(1.0, x), 6)))
        return found


def holders_of(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """How many documents hold each word, over all documents, and the number of documents."""
    hashes = np.array([W.word_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for a, b in W.slices(batch.column(0)):
                found = W.find_words(batch.column(0).slice(a, b - a), W.ALNUM)
                place = np.minimum(np.searchsorted(hashes[order], found.hash), len(order) - 1)
                known = hashes[order[place]] == found.hash
                owner = np.repeat(np.arange(b - a), found.counts)[known]
                pairs = np.unique(owner * len(vocabulary) + order[place[known]])
                totals += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        made = [pa.array([*range(len(vocabulary)), -1], pa.int32()), pa.array([*totals.tolist(), rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(tally, "word int, n long")
    # One row per word of the templates.
    totals = dict(counted.groupBy("word").agg(F.sum("n")).collect())
    return {w: totals.get(i, 0) for i, w in enumerate(vocabulary)}, totals.get(-1, 0)


def scan_licenses(
    spark: SparkSession,
    docs: DataFrame,
    *,
    base: dict[str, str] = BASE,
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """Per document: word count, places of the base phrases, labels, score and the spans found.

    Words are letters and digits and whatever is not ASCII, A-Z lowered. ``n_base`` counts all places, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without any). ``labels`` adds the method's own to
    ``base_labels``; both are distinct, sorted and joined by commas, empty without any. ``score`` is the best of all spans, 1 for a base
    phrase, 0 without any. A null or empty text has no words. Repeated rows are scanned each. Only doc_id and text are read.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vocabulary = sorted({w for t in [*base, *(t.text for t in templates)] for w in t.split()})
    index = TokenIndex(base, templates, *holders_of(named, vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")[:8]} | {"spans": []}
            for a, b in W.slices(batch.column(1)):
                found = W.find_words(batch.column(1).slice(a, b - a), W.ALNUM)
                numbers = index.numbers(found.hash)
                found_in = index.scan(numbers, found.first)
                for i in range(b - a):
                    own = found_in.get(i, ())
                    starts = [s for p, s, _ in own if p.base]
                    out["n_base"].append(len(starts))
                    out["first_word"].append(min(starts, default=None))
                    out["last_word"].append(max(starts, default=None))
                    out["base_labels"].append(",".join(sorted({p.label for p, *_ in own if p.base})))
                    out["labels"].append(",".join(sorted({p.label for p, *_ in own})))
                    out["score"].append(max((x for *_, x in own), default=0.0))
                    spans = [{"label": p.label, "start": s, "words": len(p.words), "score": x} for p, s, x in own]
                    out["spans"].append(sorted(spans, key=lambda s: (s["start"], s["label"], s["words"])))
                out["n_words"] += found.counts.tolist()
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    return named.mapInArrow(scan, RESULT)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])
ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [(c, pa.string()) for c in ("base_labels", "labels")]
    + [("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)
