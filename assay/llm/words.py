"""Words and n-grams of many texts at once, as numpy arrays over Arrow string buffers.

Both word rules of this package separate on ASCII bytes only, so they can be applied to UTF-8 bytes
without decoding. Each word becomes a 64-bit hash of its bytes; n-grams hash the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task (a longer text is handled alone).
CHUNK_BYTES = 1_000_000

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of lower-cased text
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
IDENTITY = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n bytes at least."""
    return _powers(max(1 << max(n, 1).bit_length(), 1 << 20))


@dataclass
class Chunk:
    """Words of consecutive rows of a batch; `bounds[i]:bounds[i+1]` are those of row `first + i`."""

    first: int
    rows: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams inside rows, and the place of each one's first word."""
        at = gram_places(self.bounds, n)
        return gram_hashes(self.hashes, n)[at], at


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """At each place, the hash of n words from there, whatever rows they belong to."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _GRAM
        out += hashes[k : k + m]
    return mix(out)


def gram_places(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words lie in one row."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    skip = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + skip


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut into whole rows of about `size` bytes of the text in a column."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")), first + 1)
            yield b.slice(first, last - first)
            first = last


def chunks(column: pa.Array, word: np.ndarray, fold: np.ndarray = IDENTITY, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Words of a string column, in chunks of whole rows of about `size` bytes."""
    offsets, data = buffers(column)
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1)
        yield words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, word, fold)
        first = last


def words(data: np.ndarray, offsets: np.ndarray, first: int, word: np.ndarray, fold: np.ndarray) -> Chunk:
    data = fold[data] if fold is not IDENTITY else data
    rows = len(offsets) - 1
    if not len(data):
        none = np.empty(0, np.int64)
        return Chunk(first, rows, np.empty(0, np.uint64), np.zeros(rows + 1, np.int64), none, none, data)
    inside = word[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.concatenate([[False], inside[:-1]])
    before[edge] = False
    after = np.concatenate([inside[1:], [False]])
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Chunk(first, rows, hashes, np.searchsorted(starts, offsets), starts, ends, data)
