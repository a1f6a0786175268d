from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from heirline.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  \n", "It's THE end's'll don't!!!'s", "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>a<|endoftext|>", "<| endoftext |> <|",
    "é ́ éx", "İstanbul ΣΑΣ ΑΣ. ǅ ﬁ", "a b c　d", "\x1cfoo\x1d \x00bar\x7f",
    "12345 a1b2", "日本語 한국어", "\U0001f469‍\U0001f467 x", "’s", "a\x85b c\x0bd", "ß ẞ ŉ × ÷ ª µ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "ab cé's<|endoftext|>\n\t .,!1٣ß́ Σ"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]


def test_ids_equal_the_library(library, texts):
    encoder = tokens.ChunkEncoder(*tokens.prepared(PATH))
    for _ in range(2):
        first, ids = encoder.ids(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids[first[i] : first[i + 1]].tolist() == want, repr(text)


def test_whole_words_are_proved(library):
    whole = tokens.whole_words(library)
    assert len(whole) > 20_000
    for word in random.Random(2).sample(sorted(whole), 300):
        assert library.encode(word, add_special_tokens=False).ids == [whole[word]]


def test_forgetting_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.ChunkEncoder(*tokens.prepared(PATH))
    for at in range(0, len(texts), 30):
        part = texts[at : at + 30]
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in part]
        assert encoder.counts(pa.array(part, pa.string())).tolist() == want


def test_counts(spark, docs_of, library, texts):
    rows = [*enumerate(texts), (3, texts[3]), (None, "a b")]
    got = tokens.token_counts(spark, docs_of(rows), PATH).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(spark, docs_of([]), PATH).collect() == []


def test_vocabularies_with_blanks_inside_tokens_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokens.prepared(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, ids_of, size):
    """Every id once and in order, gapless offsets, full sequences but for powers of two."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(parts) == set(ids_of)
    for doc, want in ids_of.items():
        at = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    lengths = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    odd = [n for n in lengths if n != size]
    assert all(n < size and n & (n - 1) == 0 for n in odd) and len(odd) == len(set(odd))


@pytest.mark.parametrize(("size", "parts"), [(64, 7), (4096, 3), (8, 40)])
def test_packing(spark, docs_of, library, size, parts):
    rng = random.Random(size)
    rows = [(i, " ".join(rng.choice(["the", "cat", "zq!"]) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "dog " * 5000)]
    ids_of = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    packed = packing.pack(spark, docs_of(rows).repartition(parts), PATH, size=size, most_open=4)
    check_packed(packed.collect(), ids_of, size)


def test_packing_nothing(spark, docs_of):
    assert packing.pack(spark, docs_of([]), PATH).collect() == []
    only = packing.pack(spark, docs_of([(None, None), (None, None)]), PATH).collect()
    assert [(r.doc_id, r.length, r.sequence_id) for r in only] == [(None, 1, 0)] * 2


def test_best_fit():
    packer = packing.Packer(10, 2)
    for doc, n in ((1, 6), (2, 8), (3, 2)):
        made = list(packer.add(doc, np.zeros(n, np.uint32)))
    assert [[p[0] for p in w] for w in made] == [[2, 3]]
    assert list(packer.add(4, np.zeros(9, np.uint32))) == []
    # None fits: the fullest is topped up with the head of the document.
    full = list(packer.add(5, np.zeros(7, np.uint32)))
    assert [(p[0], p[1], len(p[3])) for p in full[0]] == [(4, 0, 9), (5, 0, 1)]
    assert packing.power_cuts(13) == [0, 8, 12] and packing.power_cuts(0) == []
