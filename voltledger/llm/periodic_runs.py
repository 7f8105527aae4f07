"""Periodic runs of words and texts without their repetitions (operator 11).

A run is a longest stretch of words that has smallest period q (words q apart are equal) and at least
max(6, 4 q) words. The search is a sparse dynamic programme over diagonals: the diagonal of lag q holds at
word i how many words up to i equal the word q before them. All earlier occurrences of a word are too many
where words repeat (every word of a long run occurs in all of it), so an occurrence counts in contexts of
1, 2, 4, ... words, and in each context only the latest earlier one names a lag: in a run of period q the
stretch of q to 2 q words that begins at a word occurs last exactly q words before, as a nearer occurrence
would give the run a smaller period. So on level l (2^l words) a word extends the diagonal of its own lag
alone, if that is above 2^(l-1) and at most 2^l. The match length of the active lag grows from word to word;
where the lag changes the diagonal ends, and it emits a run there and then if the length suffices. Lags found
this way are smallest periods and stretches are longest, with no check afterwards. Words whose stretch occurs
once in a document leave the following levels, so prose costs little more than two levels; the worst case
is n log n steps and room for the words of a slice.

All documents of a slice are worked on at once as numpy arrays; contexts of different documents never meet.

Defined cases: null, empty and blank texts have no words, no runs and the collapsed text ''; a null doc_id is
never rewritten by the contract's rule; repeated rows and doc_ids are done one by one; other columns are
ignored (``collapse`` keeps them); an empty table gives no rows. Memory is bounded by a slice of 4 MB of text, or
by one longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from voltledger.llm.text_batch import Words, ranges, slices, words

LEAST_LENGTH = 6
LEAST_PERIODS = 4
ROWS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


@dataclass
class Runs:
    """Run r covers ``length[r]`` words from word ``start[r]`` of row ``row[r]`` with ``period[r]``.

    Ordered by row, start and period.
    """

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(keys: np.ndarray, bounds: np.ndarray) -> Runs:
    """The runs of all rows; equal words have equal keys, row r has words bounds[r]:bounds[r + 1]."""
    counts = np.diff(bounds)
    row_of = np.repeat(np.arange(len(counts)), counts)
    row_end = np.repeat(bounds[1:], counts)
    found = []
    # name[i] tells the stretch of `size` words that begins at i from others of the same row.
    at = np.arange(len(keys))
    at = at[counts[row_of] >= LEAST_LENGTH]
    name, previous = _named(at, row_of[at], keys[at], len(keys))
    size = 1
    while len(at):
        lag = at - previous
        lag[(previous < 0) | (lag > size) | (2 * lag <= size)] = 0
        found.append(_ended(at, lag, size))
        # Longer stretches: this one and the one after it, both of which must occur elsewhere too.
        fits = (at + 2 * size <= row_end[at]) & (counts[row_of[at]] >= LEAST_PERIODS * (size + 1))
        at = at[fits & (name[at] >= 0)]
        at = at[name[at + size] >= 0]
        first, second = name[at], name[at + size]
        name, previous = _named(at, first, second, len(keys))
        size *= 2
    if not found:
        return Runs(*(np.empty(0, np.int64) for _ in range(4)))
    start, length, period = (np.concatenate(part) for part in zip(*found))
    row = row_of[start]
    order = np.lexsort((period, start))
    row, start, length, period = (x[order] for x in (row, start, length, period))
    return Runs(row, start - bounds[row], length, period)


def _named(at: np.ndarray, first: np.ndarray, second: np.ndarray, total: int):
    """A number for each place whose pair (first, second) occurs more than once, else -1, for all
    ``total`` places; and for each of ``at`` the latest earlier place of its pair, else -1."""
    order = np.lexsort((at, second, first))
    a, b, place = first[order], second[order], at[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    name = np.full(total, -1, np.int64)
    repeated = same[:-1] | same[1:]
    name[place[repeated]] = np.cumsum(~same[:-1])[repeated]
    previous = np.full(len(at), -1, np.int64)
    later = np.flatnonzero(same[:-1])
    previous[order[later]] = place[later - 1]
    return name, previous


def _ended(at: np.ndarray, lag: np.ndarray, size: int):
    """The diagonals that end with sufficient length: start, length and period of their stretches.

    A diagonal is active from word to word while the lag stays the same.
    """
    active = lag > 0
    goes_on = np.zeros(len(at) + 1, bool)
    goes_on[1:-1] = active[1:] & (at[1:] == at[:-1] + 1) & (lag[1:] == lag[:-1])
    first = np.flatnonzero(active & ~goes_on[:-1])
    last = np.flatnonzero(active & ~goes_on[1:])
    period = lag[first]
    start = at[first] - period
    length = at[last] + size - start
    enough = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
    return start[enough], length[enough], period[enough]


def rewritten(doc_ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    """For each word the number of the word that stands in its place by the contract's rule."""
    source = np.arange(bounds[-1])
    for r, doc_id in enumerate(doc_ids):
        n = int(bounds[r + 1] - bounds[r])
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n == 0 or h is None or h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[bounds[r] + a : bounds[r + 1]] = bounds[r] + a + np.arange(n - a) % p
    return source


def kept_words(runs: Runs, bounds: np.ndarray) -> np.ndarray:
    """Which words stay when each run keeps its first period."""
    depth = np.zeros(int(bounds[-1]) + 1, np.int64)
    start = bounds[runs.row] + runs.start
    np.add.at(depth, start + runs.period, 1)
    np.add.at(depth, start + runs.length, -1)
    return np.cumsum(depth)[:-1] == 0


def joined(found: Words, source: np.ndarray, kept: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The kept words of each row joined by one space."""
    which = source[kept]
    lengths = found.ends[which] - found.starts[which] + 1
    data = np.append(found.data, np.uint8(0x20))
    flat = data[ranges(found.starts[which], lengths)]
    ends = np.cumsum(lengths)
    flat[ends - 1] = 0x20
    total = np.concatenate([[0], np.cumsum(kept)])[bounds]
    edges = np.concatenate([[0], ends])[total]
    return [flat[a : max(a, b - 1)].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _slices(batch: pa.RecordBatch, by_contract: bool):
    """Per slice its first row, its words, what stands in their places, and the runs."""
    column = batch.column("text")
    for first, last in slices(column):
        found = words(column.slice(first, last - first))
        source = np.arange(found.bounds[-1])
        if by_contract:
            ids = batch.column("doc_id").slice(first, last - first).to_pylist()
            source = rewritten(ids, found.bounds)
        yield first, found, source, find_runs(found.hashes()[source], found.bounds)


def report(docs: DataFrame) -> DataFrame:
    """Per document, with the words of some rewritten by their doc_id: the number of its runs, the one
    of greatest exponent, a hash of all, and a hash of the text without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in _names(ROWS)]
        )
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, found, source, runs in _slices(batch, by_contract=True):
                texts = joined(found, source, kept_words(runs, found.bounds), found.bounds)
                edges = np.searchsorted(runs.row, np.arange(len(texts) + 1))
                numbers = list(zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist()))
                rows = []
                for r, text in enumerate(texts):
                    own = numbers[edges[r] : edges[r + 1]]
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    top = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
                    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                    hashes = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), text))
                    rows.append((len(own), *best, *hashes))
                columns = [
                    pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def runs(docs: DataFrame) -> DataFrame:
    """All runs of the texts as they are: doc_id, start (word number), length, period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, _, _, found in _slices(batch, by_contract=False):
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(found.row + first)),
                        *(pa.array(x) for x in (found.start, found.length, found.period)),
                    ],
                    names=["doc_id", "start", "length", "period"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, period long"
    )


def collapse(docs: DataFrame) -> DataFrame:
    """The rows with the repetitions of each run cut out of their texts.

    Texts without runs, null among them, stay as they are; others are the kept words joined by one space.
    """
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found, source, runs_ in _slices(batch, by_contract=False):
                rows = len(found.bounds) - 1
                part = batch.slice(first, rows)
                texts = joined(found, source, kept_words(runs_, found.bounds), found.bounds)
                has = set(runs_.row.tolist())
                old = part.column("text")
                new = pa.array(
                    [texts[r].decode() if r in has else old[r].as_py() for r in range(rows)],
                    old.type,
                )
                columns = [new if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType(fields))
