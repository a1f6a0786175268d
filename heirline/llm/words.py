"""Words and shingles of whole batches of texts as NumPy arrays.

A batch is handled at once: bytes are classed by a table, words are the runs of one class, and
every word gets a 64-bit hash. Texts of a batch lie behind each other; ``first[i]:first[i+1]``
are the words of text ``i``. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def byte_table(separators: str, lower: bool = True) -> np.ndarray:
    """Class of each byte value: 0 for the separators, else 1."""
    table = np.ones(256, np.uint8)
    table[list(separators.encode("latin-1"))] = 0
    return table


# Words are split by ASCII white space only.
SPACED = byte_table("\t\n\x0b\x0c\r ")
# Words are letters and digits; every other ASCII character splits. Upper case is lowered first.
ALNUM = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
# As ALNUM, but runs of ASCII punctuation are words as well.
MARKED = ALNUM.copy()
MARKED[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together; one row at least."""
    sizes = np.cumsum(byte_sizes(column))
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield at, end
        at = end


def byte_sizes(column: pa.Array) -> np.ndarray:
    return np.diff(_buffers(column)[1])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``begin`` and ``end`` are byte places in ``data``, ``kind`` is the class of the bytes."""

    data: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.begin[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def texts(self, places: np.ndarray) -> list[str]:
        """Texts of words without line feeds in them."""
        data = memoryview(self.data)
        parts = [data[a:b] for a, b in zip(self.begin[places].tolist(), self.end[places].tolist(), strict=True)]
        return b"\n".join(parts).decode("utf-8", "replace").split("\n")


def find_words(column: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """The words of every text and their hashes, over whole texts."""
    data, offsets = _buffers(column)
    n = len(data)
    if lower:
        data = _LOWER[data]
    kinds = table[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    kind = kinds[begin] if n else np.zeros(0, np.uint8)
    keep = kind > 0
    # Every run of bytes is hashed as a polynomial in the place within the run.
    place = np.arange(n, dtype=np.int64) - np.repeat(begin, end - begin)
    powers = np.cumprod(np.full(int((end - begin).max(initial=0)), _BASE, np.uint64))
    values = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(values, begin)) if n else np.zeros(0, np.uint64)
    begin, end = begin[keep], end[keep]
    first = np.searchsorted(begin, offsets)
    return Words(data, first, begin, end, kind[keep], hashes[keep], offsets)


def word_hash(word: str, lower: bool = True) -> int:
    """The hash that :func:`find_words` gives a word."""
    return int(find_words(pa.array([word]), np.ones(256, np.uint8), lower).hash[0])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hash) of the runs of ``n`` words of every text, in order.

    A text with fewer words has one shingle, the whole sequence; without words, none.
    """
    counts = words.counts
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(made)])
    start = np.repeat(words.first[:-1] - first[:-1], made) + np.arange(first[-1])
    last = np.repeat(words.first[1:], made)
    out = words.hash[start].copy()
    for k in range(1, n):
        inside = start + k < last
        with_next = mix(out * STEP + words.hash[np.minimum(start + k, len(words.hash) - 1)])
        out = np.where(inside, with_next, out)
    return first, out


def distinct(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, value) with each text's values sorted and repeats dropped."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values = values.copy()
    for i in range(len(first) - 1):
        values[first[i] : first[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return np.searchsorted(owner, np.arange(len(first))), values
