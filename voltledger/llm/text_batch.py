"""Words and shingles of a batch of texts as numpy arrays, read off the Arrow buffer.

A word is a maximal run of characters other than space and ``\\x09-\\x0D``. Every word gets a 64-bit
hash that depends on its bytes and length only, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

SLICE_BYTES = 4 << 20
LONG_WORD = 4096
SHINGLE_WORDS = 5

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_HEADS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Fold one 64-bit value into each state."""
    state = (state ^ value) * _K1
    state ^= state >> np.uint64(32)
    state *= _K2
    state ^= state >> np.uint64(29)
    return state


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets that bound them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, of one row at least."""
    _, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    state = lengths.astype(np.uint64) * _K2 + _K1
    state = mix(state, eight[starts] & _HEADS[np.minimum(lengths, 8)])
    rest = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    at = 8
    while len(rest):
        left = lengths[rest] - at
        state[rest] = mix(state[rest], eight[starts[rest] + at] & _HEADS[np.minimum(left, 8)])
        rest = rest[left > 8]
        at += 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        state[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return state


@dataclass
class Words:
    """Word ``w`` is ``data[starts[w]:ends[w]]``; row ``r`` has words ``bounds[r]:bounds[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends - self.starts)

    def text(self, word: int) -> str:
        return self.data[self.starts[word] : self.ends[word]].tobytes().decode()


def words(column: pa.Array) -> Words:
    data, offsets = text_buffer(column)
    space = SPACES[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = ~space[heads], ~space[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int = SHINGLE_WORDS):
    """Hashes of all runs of ``n`` words and the bounds of each row's. A row of 1 to n - 1 words has
    one shingle of all its words, a row without words none."""
    counts = np.diff(bounds)
    end = np.repeat(bounds[1:], counts)
    position = np.arange(len(hashes))
    out = hashes.copy()
    for j in range(1, n):
        inside = np.flatnonzero(position + j < end)
        out[inside] = mix(out[inside], hashes[inside + j])
    start = np.repeat(bounds[:-1], counts)
    kept = (position + n <= end) | (position == start)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    return out[kept], np.concatenate([[0], np.cumsum(per_row)])


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text in turn."""
    for first, last in slices(column):
        found = words(column.slice(first, last - first))
        grams, bounds = shingles(found.hashes(), found.bounds, n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(grams[a:b])


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes ascending, the first place of each, and the number of each hash in them."""
    import pandas as pd

    codes, found = pd.factorize(hashes)
    place = np.empty(len(found), np.int64)
    place[codes[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], place[order], rank[codes]


class Memo:
    """Numbers of variable length kept by a 64-bit key, of a bounded number of keys.

    When the bound is passed everything is forgotten and computed anew; results do not change.
    """

    def __init__(self, kind, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.flat = np.empty(0, self.kind)

    def rows_of(self, keys: np.ndarray, compute) -> np.ndarray:
        """The rows of ascending distinct keys. compute(places) gives the values of missing ones as
        (flat values, lengths)."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            flat, lengths = compute(missing)
            rows = len(self.ends) - 1 + np.arange(len(missing))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, np.asarray(flat, self.kind)])
            self.keys = np.insert(self.keys, at[missing], keys[missing])
            self.rows = np.insert(self.rows, at[missing], rows)
            at = np.searchsorted(self.keys, keys)
        return self.rows[at]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after the other, and where each row's end."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        return self.flat[ranges(starts, lengths)], np.cumsum(lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
