"""Token counts and ids of whole texts under a public tokenizer file.

Texts are split at ASCII white space, which no token of the supported vocabularies spans, and
every distinct chunk is encoded once per worker process. Inside a chunk, pre-tokens that the vocabulary
holds as a whole are one token each; only the others go through the merges.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain, compress, count, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirline.llm import words as W

WORD_END = "</w>"
# Distinct chunks that a worker remembers before it starts afresh.
REMEMBERED = 400_000
# Pieces that go through the merges together.
JOINED = 5_000
# The split rule of the vocabulary file for lower-case text of ASCII and Latin letters (fixed values).
# Line feeds stand between chunks.
PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+")
# What the rule does not cover: other letters and marks, and what may be a special string.
SPECIAL = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\|")
SLICE_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(text)
    made.no_truncation()
    made.no_padding()
    return made


def whole_words(tokenizer) -> dict[str, int]:
    """Vocabulary strings under the rule that stand for a pre-token and encode alone as one token, with its id.

    Proved by encoding each of them, so a string that the merges do not reach is left out.
    """
    letters = byte_letters()
    found: list[str] = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        stem = entry.removesuffix(WORD_END)
        if stem == entry or not all(c in letters for c in stem):
            continue
        text = bytes(letters[c] for c in stem).decode("utf-8", "replace")
        if not SPECIAL.search(text) and PIECES.fullmatch(text):
            found.append(text)
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return {text: e.ids[0] for text, e in zip(found, encoded, strict=True) if len(e.ids) == 1}


def prepared(path: str) -> tuple[str, dict[str, int]]:
    """The tokenizer file and its whole words; both are as large as the vocabulary, not the data."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    tokenizer = load(text)
    for probe in ("a b", "it's\n\tso", "x é 1\r2"):
        parts = [tokenizer.encode(p, add_special_tokens=False).ids for p in probe.split()]
        if tokenizer.encode(probe, add_special_tokens=False).ids != list(chain(*parts)):
            raise ValueError("tokens of this vocabulary span white space")
    return text, whole_words(tokenizer)


class Ragged:
    """Numbered lists of ids, one behind the other."""

    def __init__(self, pool: np.ndarray, sizes: np.ndarray):
        self.pool, self.sizes = pool, sizes
        self.starts = np.cumsum(sizes) - sizes

    def add(self, pool: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, pool])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The lists with these numbers, one behind the other."""
        sizes = self.sizes[numbers].astype(np.int32)
        shift = self.starts[numbers].astype(np.int32) - (np.cumsum(sizes, dtype=np.int32) - sizes)
        places = np.repeat(shift, sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.pool[places]


class ChunkEncoder:
    """Encodes batches of texts, remembering distinct chunks and the pieces that they split into.

    Both are numbered; the ids of number i are ``pool[starts[i]:starts[i] + sizes[i]]``.
    """

    def __init__(self, text: str, whole: dict[str, int]):
        self.tokenizer = load(text)
        self.whole = whole
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for entry, i in vocabulary.items() if entry.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        # Number 0 stands for the break between chunks and has no ids.
        self.pieces: dict[str, int] = {p: i for i, p in enumerate(["\n", *self.whole])}
        sizes = np.ones(len(self.pieces), np.int64)
        sizes[0] = 0
        self.piece_ids = Ragged(np.fromiter(self.whole.values(), np.uint32, len(self.whole)), sizes)
        self.chunks: dict[int, int] = {}
        self.chunk_ids = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def learn(self, keys: list[int], chunks: list[str]) -> None:
        """Split new chunks into pieces and merge those that are new; what the vocabulary holds as a whole is not merged."""
        plain = np.fromiter((SPECIAL.search(c) is None for c in chunks), bool, len(chunks))
        parts = PIECES.findall("\n".join(compress(chunks, plain)).lower())
        # Chunks outside the rule are pieces by themselves, and left to the library.
        others = list(compress(chunks, ~plain))
        new = [p for p in dict.fromkeys(parts) if p not in self.pieces]
        self.merge(new, True)
        self.merge([c for c in others if c not in self.pieces], False)
        flat = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        breaks = np.flatnonzero(flat == 0)
        counts = np.diff(np.concatenate([[-1], breaks, [len(flat)]])) - 1 if plain.any() else np.zeros(0, np.int64)
        flat = flat[flat > 0]
        sizes = np.concatenate([[0], np.cumsum(self.piece_ids.sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])]
        self.chunk_ids.add(self.piece_ids.take(flat), np.diff(sizes))
        lone = np.fromiter(map(self.pieces.__getitem__, others), np.int64, len(others))
        self.chunk_ids.add(self.piece_ids.take(lone), self.piece_ids.sizes[lone])
        ordered = chain(compress(keys, plain), compress(keys, ~plain))
        self.chunks.update(zip(ordered, count(len(self.chunks)), strict=False))

    def merge(self, new: list[str], single: bool) -> None:
        """Encode new pieces, many as one text with blanks between; ``single``: each is one pre-token."""
        for at in range(0, len(new), JOINED):
            part = new[at : at + JOINED]
            text = " ".join(part)
            if single:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
            else:
                made = self.tokenizer.encode(text, add_special_tokens=False)
                ids = np.array(made.ids, np.uint32)
                begin = np.fromiter((a for a, _ in made.offsets), np.int64, len(ids))
                cuts = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in part]))
            if len(cuts) != len(part):
                raise ValueError("pieces and pre-tokens differ")
            self.piece_ids.add(ids, np.diff(cuts, prepend=0))
            self.pieces.update(zip(part, count(len(self.pieces)), strict=False))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, chunk): the numbers of the chunks of every text."""
        words = W.find_words(column, W.SPACED, lower=False)
        distinct, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.chunks) + len(distinct) > REMEMBERED:
            self.forget()
        keys = distinct.tolist()
        place = np.fromiter(map(self.chunks.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            missed = distinct[missing].tolist()
            self.learn(missed, words.texts(at[missing]))
            place[missing] = np.fromiter(map(self.chunks.__getitem__, missed), np.int64, len(missed))
        return words.first, place[inverse]

    def counts(self, column: pa.Array) -> np.ndarray:
        first, chunk = self(column)
        return np.diff(np.concatenate([[0], np.cumsum(self.chunk_ids.sizes[chunk])])[first])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of text ``i`` are ``ids[first[i]:first[i+1]]``."""
        first, chunk = self(column)
        return np.concatenate([[0], np.cumsum(self.chunk_ids.sizes[chunk])])[first], self.chunk_ids.take(chunk)


def encoder_of(prepared_file: tuple[str, dict[str, int]]) -> ChunkEncoder:
    """The encoder of this worker process, which keeps what earlier tasks have learned."""
    kept = sys.modules.setdefault("heirline_worker_encoders", ModuleType("heirline_worker_encoders"))
    text, whole = prepared_file
    name = "of_" + hashlib.sha256(text.encode()).hexdigest()
    if not hasattr(kept, name):
        setattr(kept, name, ChunkEncoder(text, whole))
    return getattr(kept, name)


def token_counts(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text, as the tokenizer file counts without added tokens.

    A null text counts as empty, with 0 bytes and 0 tokens; repeated rows stay. Other columns of
    ``docs`` are not read. Whole texts are counted, whatever their length. Special strings inside
    a text are what the library makes of them by default.
    """
    shared = spark.sparkContext.broadcast(prepared(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            column = batch.column(1)
            totals = [encoder.counts(column.slice(a, b - a)) for a, b in W.slices(column, SLICE_BYTES)]
            made = [batch.column(0), pa.array(W.byte_sizes(column)), pa.array(np.concatenate(totals or [np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
