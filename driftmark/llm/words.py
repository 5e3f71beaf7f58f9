"""Words of whole Arrow text columns as NumPy arrays.

Texts stay UTF-8 bytes.  Both word rules of this package only name ASCII
characters as separators, so a byte table decides what belongs to a word and
no text has to be decoded.  A block of texts is cut into words in a few vector
operations, and each word gets a 64-bit hash from prefix sums of a polynomial.
Blocks hold about a megabyte of text, so memory follows the longest single
text, never the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: Bytes of words between ASCII blanks: everything but 0x20 and 0x09-0x0D.
BLANK_RULE = np.ones(256, dtype=bool)
BLANK_RULE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII digits, small letters and anything beyond ASCII (texts are lower-cased before).
ALNUM_RULE = np.zeros(256, dtype=bool)
ALNUM_RULE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        steps = np.full(max(length, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.multiply.accumulate(steps)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that any bits of the result may be used (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Some texts: ``first[i]:first[i+1]`` are the words of text ``i``."""

    data: np.ndarray  # the bytes, A-Z lower-cased
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``most`` bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n + 1)[:n], out=sums[1:])
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        value = (sums[ends] - sums[self.starts]) * _power_table(_BASE_INVERSE, n + 1)[self.starts]
        return mix(value + (ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j-1 with one blank between them."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by the run's first word (runs across texts included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + n]
    return mix(out)


def cut(texts: pa.Array, rule: np.ndarray) -> Block:
    """The block of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    raw, offsets = _LOWER[raw], offsets - offsets[0]
    inside = rule[raw]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[(offsets < len(raw))]
    begin[edges] = inside[edges]  # a word never runs from one text into the next
    edges = offsets[(offsets > 0)] - 1
    finish[edges] = inside[edges]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Block(raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(batch: pa.RecordBatch, column: str, rule: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of a batch with about BLOCK_BYTES of text each, and their words; longer single texts stand alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    i = 0
    while i < batch.num_rows:
        before = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
        part = batch.slice(i, j - i)
        yield part, cut(texts.slice(i, j - i), rule)
        i = j
