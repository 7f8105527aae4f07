"""Toxicity of texts by a convolutional network over hashed words (operator 6).

Each word has the sum of three hashed embeddings: two of the word, so that two words look alike only
when they collide twice, and one of its first four bytes, so that forms of a stem have something in
common. Filters of one, two and three words slide over the whole text; the largest answer of each filter
goes into a logistic layer. The network is trained in numpy by gradient steps, through the place of
each maximum. The threshold of each language, guessed from the text itself, is calibrated on the
training rows, and scores are bent so that it comes to 0.3. Labels come only from rows whose crc32 of
doc_id leaves a remainder other than 2; of these, ``TRAINING_ROWS`` are taken by hash, which bounds the
fit; as toxic rows are rare, up to ``TOXIC_SHARE`` of these are toxic. Neither labels nor lang, source
and doc_id enter a score.

Defined cases: null texts count as empty; every text gets a score, the empty one too; without any
usable label all scores are 0; equal texts have equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltledger.llm.features import remainder, training_rows
from voltledger.llm.text_batch import SPACES, Words, hash_spans, slices, words

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
TRAINING_ROWS = 5000
TOXIC_SHARE = 1 / 3
BUCKETS = 1 << 16
WIDTH = 8
FILTERS = 6
SPANS = (1, 2, 3)
EPOCHS = 8
BATCH = 32
RATE = 0.02

_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


STEM = 4


def _hashes(found: Words) -> np.ndarray:
    """A row of three bucket numbers per word, in lower case without ASCII signs at its ends: two of
    the word and one of its stem."""
    data = _LOWER[found.data]
    starts, ends = found.starts.copy(), found.ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        live = np.arange(len(starts))
        while len(live):
            live = live[_EDGE[data[edge[live] if step > 0 else edge[live] - 1]]]
            edge[live] += step
            live = live[starts[live] < ends[live]]
    whole = hash_spans(data, starts, ends - starts)
    stem = hash_spans(data, starts, np.minimum(ends - starts, STEM))
    mask = np.uint64(BUCKETS - 1)
    three = (whole & mask, (whole >> np.uint64(24)) & mask, (stem >> np.uint64(12)) & mask)
    return np.stack(three, axis=1).astype(np.int32)


# Bytes that follow 0xC3 in letters of one language; other texts count as English.
_MARKS = {"de": b"\xa4\xb6\xbc\x9f", "es": b"\xb1\xb3\xad\xba\xa1", "fr": b"\xa8\xaa\xa7\xa0\xa9"}
LANGUAGES = ("en", *_MARKS)


def _languages(found: Words, offsets: np.ndarray) -> np.ndarray:
    """The likeliest language of each text by its accented letters: a place in LANGUAGES."""
    after = np.flatnonzero(found.data[:-1] == 0xC3) + 1 if len(found.data) else np.empty(0, np.int64)
    rows = np.searchsorted(offsets, after, side="right") - 1
    counts = np.zeros((len(offsets) - 1, len(LANGUAGES)))
    for k, marks in enumerate(_MARKS.values(), 1):
        mine = np.isin(found.data[after], np.frombuffer(marks, np.uint8))
        counts[:, k] = np.bincount(rows[mine], minlength=len(offsets) - 1)
    counts[:, 0] = np.diff(offsets) / 200
    return counts.argmax(axis=1)


class Network:
    def __init__(self):
        random = np.random.default_rng(6)
        self.one = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.two = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.stem = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        # Filters of one word first, then of two, then of three; a block per word of each.
        self.blocks = sum(SPANS)
        self.filters = random.normal(0, 0.3, (WIDTH, self.blocks * FILTERS)).astype(np.float32)
        self.shift = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.out = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.bias = np.float32(-1)
        self.limits = np.full(len(LANGUAGES), 0.5)

    def vectors(self, hashes: np.ndarray) -> np.ndarray:
        return self.one[hashes[:, 0]] + self.two[hashes[:, 1]] + self.stem[hashes[:, 2]]

    def answers(self, hashes: np.ndarray, bounds: np.ndarray):
        """The largest answer of each filter in each text and the word at which it begins; a text
        without words, or shorter than a filter, is filled up with words of zeros."""
        n, rows = len(hashes), len(bounds) - 1
        empty = np.zeros(1, np.float32)
        best = np.tile(self.shift, (rows, 1))
        where = np.full((rows, len(SPANS) * FILTERS), -1, np.int64)
        if not n:
            return best, where
        each = self.vectors(hashes) @ self.filters
        end = np.repeat(bounds[1:], np.diff(bounds))
        full = np.flatnonzero(np.diff(bounds) > 0)
        block = 0
        for k, span in enumerate(SPANS):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            total = each[:, block * FILTERS : (block + 1) * FILTERS].copy()
            for j in range(1, span):
                more = each[j:, (block + j) * FILTERS : (block + j + 1) * FILTERS]
                inside = (np.arange(n - j) + j < end[: n - j])[:, None] if n > j else empty
                if n > j:
                    total[: n - j] += more * inside
            block += span
            top = np.maximum.reduceat(total, bounds[:-1][full], axis=0)
            best[full, columns] = top + self.shift[columns]
            if self.training:
                owner = np.repeat(np.arange(len(full)), np.diff(bounds)[full])
                for f in range(FILTERS):
                    hit = np.flatnonzero(total[:, f] == top[owner, f])
                    _, first = np.unique(owner[hit], return_index=True)
                    where[full, k * FILTERS + f] = hit[first]
        return best, where

    training = False
    tables = ("one", "two", "stem")

    def margin(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        best, _ = self.answers(hashes, bounds)
        return np.maximum(best, 0) @ self.out + self.bias

    def fit(self, hashes: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> None:
        random = np.random.default_rng(66)
        self.out = random.normal(0, 0.5, len(self.out)).astype(np.float32)
        seen = {name: np.full_like(getattr(self, name), 1e-3) for name in (*self.tables, "filters", "shift", "out")}
        share = labels.mean()
        balance = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        self.training = True
        for _ in range(EPOCHS):
            for picked in np.array_split(random.permutation(len(labels)), max(1, len(labels) // BATCH)):
                pieces = [hashes[bounds[r] : bounds[r + 1]] for r in picked]
                own = np.concatenate(pieces)
                own_bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                self._step(own, own_bounds, labels[picked], balance[picked], seen)
        self.training = False

    def _move(self, name: str, at, gradient: np.ndarray, seen: dict) -> None:
        value = getattr(self, name)
        seen[name][at] += gradient * gradient
        value[at] -= RATE * gradient / np.sqrt(seen[name][at])

    def _step(self, hashes, bounds, labels, balance, seen) -> None:
        best, where = self.answers(hashes, bounds)
        kept = np.maximum(best, 0)
        margin = kept @ self.out + self.bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * balance / len(labels)
        error = error.astype(np.float32)
        below = (error[:, None] * self.out) * (best > 0)
        words_at, slopes = [], []
        filter_slope = np.zeros_like(self.filters)
        block = 0
        ends = bounds[1:]
        for k, span in enumerate(SPANS):
            for j in range(span):
                for f in range(FILTERS):
                    c = k * FILTERS + f
                    place = where[:, c] + j
                    use = (where[:, c] >= 0) & (place < ends) & (below[:, c] != 0)
                    at, slope = place[use], below[use, c]
                    column = (block + j) * FILTERS + f
                    filter_slope[:, column] += slope @ self.vectors(hashes[at])
                    words_at.append(at)
                    slopes.append(slope[:, None] * self.filters[:, column])
            block += span
        at, slope = np.concatenate(words_at), np.concatenate(slopes)
        for column, name in enumerate(self.tables):
            places, code = np.unique(hashes[at, column], return_inverse=True)
            total = np.zeros((len(places), WIDTH), np.float32)
            np.add.at(total, code, slope)
            self._move(name, places, total, seen)
        self._move("filters", slice(None), filter_slope, seen)
        self._move("shift", slice(None), below.sum(axis=0), seen)
        self._move("out", slice(None), error @ kept + 1e-5 * self.out, seen)
        self.bias -= np.float32(RATE) * error.sum()

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> None:
        """The margin of each language that parts its training rows best, by the F-measure; languages
        with few toxic rows take that of all rows."""

        def best(m: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-m)
            hit = np.cumsum(y[order])
            f = 2 * hit / (np.arange(1, len(m) + 1) + y.sum())
            k = int(f.argmax())
            following = m[order[k + 1]] if k + 1 < len(m) else m[order[k]] - 1
            return float((m[order[k]] + following) / 2)

        self.limits[:] = best(margins, labels)
        for k in range(len(LANGUAGES)):
            mine = languages == k
            if labels[mine].sum() >= 30 and (1 - labels[mine]).sum() >= 30:
                self.limits[k] = best(margins[mine], labels[mine])

    def scores(self, margins: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """0.3 at the language's threshold."""
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margins - self.limits[languages] + shift, -30, 30)))


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    from voltledger.llm.text_batch import text_buffer

    for first, last in slices(column, 1 << 20):
        part = column.slice(first, last - first)
        found = words(part)
        yield _hashes(found), found.bounds, _languages(found, text_buffer(part)[1])


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted on the driver to a bounded sample of labelled rows."""
    rows = training_rows(docs, labels, "toxic", remainder(FOLDS) != HELD_OUT, TRAINING_ROWS, TOXIC_SHARE)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_hashed(batch.column("text")))
            counts = [3 * n for _, bounds, _ in parts for n in np.diff(bounds)]
            ends = np.cumsum([0, *counts]).astype(np.int32)
            flat = np.concatenate([np.empty((0, 3), np.int32), *(h for h, _, _ in parts)]).ravel()
            guessed = np.concatenate([np.empty(0, np.int64), *(g for _, _, g in parts)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(guessed.astype(np.int32)),
                ],
                names=["doc_id", "label", "words", "language"],
            )

    table = rows.mapInArrow(extract, "doc_id long, label int, words array<int>, language int").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    answers = table.column("label").to_numpy().astype(np.float32)
    if len(answers) == 0 or answers.min() == answers.max():
        return None
    column = table.column("words").combine_chunks()
    hashes = column.flatten().to_numpy().reshape(-1, 3)
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]) // 3
    network = Network()
    network.fit(hashes, bounds, answers)
    margins = np.concatenate(
        [
            network.margin(hashes[bounds[r] : bounds[min(r + 256, len(answers))]],
                           bounds[r : r + 257] - bounds[r])
            for r in range(0, len(answers), 256)
        ]
    )
    network.calibrate(margins, answers, table.column("language").to_numpy())
    return network


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (label 1 likelier when higher) and predicted."""
    network = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.empty(0)]
            for hashes, bounds, languages in _hashed(batch.column("text")):
                if network is None:
                    parts.append(np.zeros(len(languages)))
                else:
                    parts.append(network.scores(network.margin(hashes, bounds), languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(parts).astype(float))],
                names=["doc_id", "score"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
