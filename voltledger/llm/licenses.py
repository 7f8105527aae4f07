"""License notices in texts by MinHash bands over overlapping windows (operator 8).

The notices are an argument: a table of licenses and their notices, ``license_notices`` where none is given;
licenses outside the table are not looked for. Words are compared in lower case without punctuation at
their ends. A template is a notice as a run of words, or several runs with `` ... `` between them; its set
is that of its five-word shingles. For each size class of templates (1, 2, 4, 8, ...
shingles) every text is cut into windows of twice that many shingles, each overlapping half of the next, so a
notice lies whole in one of them. Every window of every text has its minimum under each permutation looked up in
the band table of its class, which leads from a band (one row each) and its minimum to templates; a window is
compared with the templates so retrieved and with no others. A class has as many bands as it takes to
miss a window with a valid notice with a chance of at most ``MISS`` (``bands_of``, ``collision_probability``).
What is retrieved is verified: the share of the template's shingles that the window holds must be 0.8 or more.

Licenses share their wording. Where the notice of another license holds 0.8 of a template, a window must
also hold more than half of the shingles that this other notice lacks, so no license is named by words that
are another's as well. Where places overlap, a notice whose found shingles are among those of another
license's found notice gives way to it (a BSD clause to the longer license).

Defined cases: null and empty texts hold no notice; rows are judged one by one, so equal rows give equal
results; null doc_ids are kept as null; a document without notice gives no row; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import groupby
from math import ceil, log
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltledger.llm.license_notices import NOTICES
from voltledger.llm.text_batch import SHINGLE_WORDS, hash_spans, ranges, shingles, text_buffer, words

CONTAINMENT = (4, 5)
# Chance that the bands of a class miss a window with a notice that just passes.
MISS = 1e-5
ROWS = "doc_id long, license string, containment double, windows long, first_char long, end_char long"

# Shingles that the words between two runs of a notice may take up.
GAP = 16
TEMPLATES = NOTICES

_EDGE = np.ones(128, bool)
_EDGE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _shingles(column: pa.Array):
    """Shingles of the normal words of each row: hashes, bounds, and the words they were made of."""
    found = words(column)
    data = _LOWER[found.data]
    starts, ends = found.starts.copy(), found.ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        live = np.arange(len(starts))
        while len(live):
            byte = data[edge[live] if step > 0 else edge[live] - 1]
            live = live[(byte < 128) & _EDGE[np.minimum(byte, 127)]]
            live = live[starts[live] < ends[live]]
            edge[live] += step
            live = live[starts[live] < ends[live]]
    full = starts < ends  # a word of punctuation alone is none
    number = np.concatenate([[0], np.cumsum(full)])
    bounds = number[found.bounds]
    starts, ends = starts[full], ends[full]
    grams, gram_bounds = shingles(hash_spans(data, starts, ends - starts), bounds)
    return grams, gram_bounds, starts, ends, bounds


def _permutation(band: int) -> tuple[np.uint32, np.uint32]:
    a, b = np.random.default_rng([8, band]).integers(0, 1 << 32, 2, dtype=np.uint32)
    return a | np.uint32(1), b


def _permuted(grams: np.ndarray, band: int) -> np.ndarray:
    """The grams as a band orders them, 32 bits each: what collides is verified like all else."""
    a, b = _permutation(band)
    mixed = grams.astype(np.uint32) * a + b
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed ^ (mixed >> np.uint32(12))


def similarity(shingles_of_template: int) -> float:
    """The least Jaccard similarity of a template to a window that holds enough of it."""
    part, whole = CONTAINMENT
    shared = -(-part * shingles_of_template // whole)
    return shared / (2 * _class_of(shingles_of_template) + shingles_of_template - shared)


@lru_cache(maxsize=None)
def bands_of(size: int) -> int:
    """Bands of a class: enough for each size of template in it."""
    least = min(similarity(n) for n in range(size // 2 + 1, size + 1))
    return ceil(log(MISS) / log(1 - least))


def collision_probability(shingles_of_template: int) -> float:
    """The least chance that a window with a valid notice meets its template."""
    return 1 - (1 - similarity(shingles_of_template)) ** bands_of(_class_of(shingles_of_template))


def _class_of(count: int) -> int:
    return 1 << (count - 1).bit_length()


def _table(templates: Mapping[str, Sequence[str]] | DataFrame) -> tuple[tuple[str, str], ...]:
    """(license, notice) of a mapping or of a frame with these columns, which has to be small."""
    if isinstance(templates, DataFrame):
        pairs = [(row.license, row.notice) for row in templates.select("license", "notice").collect()]
    else:
        pairs = [(name, notice) for name, notices in templates.items() for notice in notices]
    for name, notice in pairs:
        if name is None or notice is None:
            raise ValueError("A notice or its license is null!")
        for piece in notice.split(" ... "):
            if len(_shingles(pa.array([piece]))[2]) < SHINGLE_WORDS:
                raise ValueError(f"A notice of {name} has fewer than {SHINGLE_WORDS} words in a run: {piece}")
    return tuple(pairs)


class Template(NamedTuple):
    license: str
    grams: np.ndarray
    size: int
    # What each notice of another license lacks that holds most of this one.
    beyond: list[np.ndarray]


class Band(NamedTuple):
    """Minima of the templates of a class in one band, ascending, and whose they are; ``low`` tells by the
    last 16 bits which minima can be among them at all."""

    minima: np.ndarray
    owners: np.ndarray
    low: np.ndarray


@lru_cache(maxsize=4)
def _templates(pairs: tuple[tuple[str, str], ...]) -> tuple[list[Template], dict[int, list[Band]]]:
    """The templates, and by size class the bands that lead to them."""
    sets = []
    for name, notice in pairs:
        pieces = notice.split(" ... ")
        grams = np.unique(_shingles(pa.array(pieces))[0])
        sets.append((name, grams, _class_of(len(grams) + GAP * (len(pieces) - 1))))
    part, whole = CONTAINMENT
    templates, by_class = [], {}
    for name, grams, size in sets:
        beyond = []
        for other, theirs, _ in sets:
            lacks = np.setdiff1d(grams, theirs, True)
            if other != name and len(lacks) and whole * (len(grams) - len(lacks)) >= part * len(grams):
                beyond.append(lacks)
        by_class.setdefault(size, []).append(len(templates))
        templates.append(Template(name, grams, size, beyond))
    bands = {}
    for size, owners in sorted(by_class.items()):
        bands[size] = []
        for band in range(bands_of(size)):
            minima = np.array([_permuted(templates[i].grams, band).min() for i in owners], np.uint32)
            order = np.argsort(minima, kind="stable")
            low = np.zeros(1 << 16, bool)
            low[minima & 0xFFFF] = True
            bands[size].append(Band(minima[order], np.array(owners)[order], low))
    return templates, bands


def _blocks(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``step`` begin, cut row by row, and the bounds of each row's blocks."""
    counts = -(-np.diff(bounds) // step)
    own = np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(own[-1]) - np.repeat(own[:-1], counts)
    return np.repeat(bounds[:-1], counts) + inside * step, own


def retrieve(
    grams: np.ndarray, bounds: np.ndarray, bands: Mapping[int, Sequence[Band]]
) -> np.ndarray:
    """(row, class, first shingle of the window in its row, template) of each window and template that agree
    in a band, each once and ascending."""
    if not len(grams) or not bands:
        return np.empty((0, 4), np.int64)
    # The blocks of a class are made of those of the class below it; a window is two of its blocks.
    levels, below, smaller = [], bounds, 1
    for size in bands:
        starts, own = _blocks(below, size // smaller)
        counts = np.diff(own)
        final = own[1:][counts > 0] - 1
        last_window = np.repeat(np.maximum(counts - 2, 0), counts)
        levels.append((size, starts, own, final, last_window))
        below, smaller = own, size
    found = []
    for band in range(max(map(len, bands.values()))):
        least = _permuted(grams, band)
        for size, starts, own, final, last_window in levels:
            least = least if len(starts) == len(least) else np.minimum.reduceat(least, starts)
            if band >= len(bands[size]):
                continue
            window = least.copy()
            np.minimum(least[:-1], least[1:], out=window[:-1])
            window[final] = least[final]  # nothing of the next row
            minima, owners, low = bands[size][band]
            block = np.flatnonzero(low[window & np.uint32(0xFFFF)])
            values = window[block]
            first = np.searchsorted(minima, values)
            agree = np.searchsorted(minima, values, side="right") - first
            block, whose = np.repeat(block, agree), owners[ranges(first, agree)]
            row = np.searchsorted(own, block, side="right") - 1
            at = np.minimum(block - own[row], last_window[block]) * size
            found.append(np.stack([row, np.full(len(row), size), at, whose], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _gives_way(one: tuple, other: tuple) -> bool:
    """Whether the other notice found accounts for all that this one was found by, and for more."""
    name, share, shared, place = one
    their_name, their_share, more, their_place = other
    if name != their_name and (place[0] > their_place[-1] or their_place[0] > place[-1]):
        return False
    if not (their_share > share or (name != their_name and len(more) > len(shared))):
        return False
    return bool(np.isin(shared, more).all())


def verified(own: np.ndarray, windows: Sequence[tuple[int, int, int]], templates: Sequence[Template]) -> list:
    """Of the windows (class, first shingle, template) of a text those that hold their template: license,
    containment, shared shingles and their places."""
    part, whole = CONTAINMENT
    held = []
    for size, first, number in windows:
        name, wanted, _, beyond = templates[number]
        inside = own[first : first + 2 * size]
        shared = np.intersect1d(inside, wanted)
        own_words = all(2 * np.isin(x, shared).sum() > len(x) for x in beyond)
        if whole * len(shared) >= part * len(wanted) and own_words:
            place = first + np.flatnonzero(np.isin(inside, shared))
            held.append((name, len(shared) / len(wanted), shared, place))
    return held


def find_in(
    column: pa.Array, pairs: tuple[tuple[str, str], ...]
) -> Iterator[tuple[int, str, float, int, int, int]]:
    """(row, license, containment, windows, first and end byte) of each notice of each text."""
    templates, bands = _templates(pairs)
    grams, bounds, starts, ends, word_bounds = _shingles(column)
    met = retrieve(grams, bounds, bands)
    _, offsets = text_buffer(column)
    for row, rows_of in groupby(met.tolist(), key=itemgetter(0)):
        own = grams[bounds[row] : bounds[row + 1]]
        held = verified(own, [tuple(window[1:]) for window in rows_of], templates)
        best: dict[str, list] = {}
        for notice in held:
            if any(_gives_way(notice, other) for other in held):
                continue
            name, share, _, place = notice
            base = word_bounds[row]
            final = min(int(place[-1]) + SHINGLE_WORDS, word_bounds[row + 1] - base) - 1
            span = (int(starts[base + place[0]]), int(ends[base + final]))
            entry = best.setdefault(name, [0.0, 0, *span])
            entry[0] = max(entry[0], share)
            entry[1] += 1
            entry[2:] = min(tuple(entry[2:]), span)
        for name in sorted(best):
            share, count, first, end = best[name]
            yield int(row), name, share, count, first - int(offsets[row]), end - int(offsets[row])


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] | DataFrame = TEMPLATES) -> DataFrame:
    """One row per document and license: the largest containment, the number of windows that hold it,
    and the characters of the first one (end exclusive). ``templates`` are notices by license, or a small
    frame of them (license, notice)."""
    pairs = _table(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voltledger.llm.text_batch import slices

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            out = []
            for first, last in slices(texts):
                part = texts.slice(first, last - first)
                for row, license, share, count, start, end in find_in(part, pairs):
                    raw = part[row].as_py().encode()
                    chars = len(raw[:start].decode()), len(raw[:end].decode())
                    out.append((names[first + row], license, share, count, *chars))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=[field.split()[0] for field in ROWS.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)
