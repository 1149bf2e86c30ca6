"""Vectorised words and word shingles of Arrow string columns.

A batch is cut into blocks of a bounded number of bytes (a longer text is a block of its own), so that the
arrays a task holds stay small however many rows a batch has. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

#: Bytes that separate words: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that separate words where punctuation doesn't count: all ASCII but letters and digits.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = [not chr(b).isalnum() for b in range(128)]

#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Odd factors for the places of a word within a shingle.
PLACES = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, min(2 * len(cls.up), BLOCK_BYTES + 1))
            for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


@dataclass
class Block:
    """Texts first..last of a batch: their bytes, and where each begins (one entry more than texts)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return self.last - self.first


@dataclass
class Words:
    """start, end: byte positions in the block; text: which text of the block; hash: of each word."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    per_text: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(block: Block, separators: np.ndarray = WHITE, fold: bool = True) -> Words:
    """The words of a block's texts: maximal runs without separator bytes, A-Z lower-cased if fold."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(block.texts, np.int64))
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    up, down = Powers.upto(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[LOWER[data] if fold else data] * up[:n], out=sums[1:])
    return Words(start, end, text, mix((sums[end] - sums[start]) * down[start]), np.bincount(text, minlength=block.texts))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a text, and the index of its first word."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(w.hash) - n + 1
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h += w.hash[k : k + count] * PLACES[k]
    at = np.flatnonzero(w.text[:count] == w.text[n - 1 :])
    return mix(h[at]), at


def shingle_sets(w: Words, texts: int, n: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct n-word shingles; fewer words are one shingle, no words the empty set."""
    h, at = ngrams(w, n)
    cuts = np.searchsorted(w.text[at], np.arange(texts + 1))
    firsts = np.concatenate([[0], np.cumsum(w.per_text)])
    out = []
    for i in range(texts):
        if w.per_text[i] >= n:
            out.append(np.unique(h[cuts[i] : cuts[i + 1]]))
        else:
            own = w.hash[firsts[i] : firsts[i + 1]]
            whole = (own * PLACES[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))
            out.append(mix(whole) if len(own) else own)
    return out
