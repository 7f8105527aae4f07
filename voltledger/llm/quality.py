"""Quality scores of texts by a factorisation machine (operator 5).

The features of a text are its words, hashed, their weights scaled to length one; measures of its
structure; and its length in characters. The machine adds to a linear score the products of
all pairs of features, weighted by inner products of low-rank vectors; the sum over all pairs is half
of (square of the sum minus sum of the squares) in each dimension, so scoring takes time linear in the
number of words. Labels come only from rows whose crc32 of doc_id leaves a remainder other than 0; of
these, ``TRAINING_ROWS`` are taken by hash, which bounds the fit. Neither labels nor lang, source and
doc_id enter a score.

Defined cases: null texts count as empty; every text gets a score, the empty one too; without any
usable label all scores are 0.5; equal texts have equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltledger.llm.features import remainder, structure, training_rows
from voltledger.llm.text_batch import slices, words

FOLDS = 5
THRESHOLD = 0.3
TRAINING_ROWS = 4000
BUCKETS = 1 << 13
RANK = 6
EPOCHS = 12
BATCH = 64
RATE = 0.05

_ROWS = "doc_id long, held_out boolean, score double, predicted int"


class Features:
    """Sparse rows: features ``index[bounds[r]:bounds[r + 1]]`` with ``value``."""

    def __init__(self, column: pa.Array):
        index, value, bounds = [], [], [0]
        texts = column.to_pylist()
        row = 0
        for first, last in slices(column):
            found = words(column.slice(first, last - first))
            hashed = (found.hashes() % np.uint64(BUCKETS)).astype(np.int64)
            for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                text = texts[row] or ""
                row += 1
                buckets, counts = np.unique(hashed[a:b], return_counts=True)
                weight = counts.astype(float)
                if len(weight):
                    weight /= np.sqrt(weight @ weight)
                measures = np.array([1.0, *structure(text, text.split()), min(len(text), 40000) / 40000])
                index += [buckets, BUCKETS + np.arange(len(measures))]
                value += [weight, measures]
                bounds.append(bounds[-1] + len(buckets) + len(measures))
        self.index = np.concatenate(index) if index else np.empty(0, np.int64)
        self.value = np.concatenate(value) if value else np.empty(0)
        self.bounds = np.array(bounds)
        self.width = BUCKETS + 16

    def __len__(self) -> int:
        return len(self.bounds) - 1


class FactorisationMachine:
    def __init__(self, width: int):
        random = np.random.default_rng(5)
        self.linear = np.zeros(width)
        self.factors = random.normal(0, 0.05, (width, RANK))

    def sums(self, at: np.ndarray, value: np.ndarray, bounds: np.ndarray):
        """Linear score, and sum and sum of squares of each dimension, of each row."""
        part = self.factors[at] * value[:, None]
        starts = bounds[:-1]
        total = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part * part, starts, axis=0)
        return np.add.reduceat(self.linear[at] * value, starts), total, squares

    def margin(self, features: Features) -> np.ndarray:
        linear, total, squares = self.sums(features.index, features.value, features.bounds)
        return linear + 0.5 * (total**2 - squares).sum(axis=1)

    def fit(self, features: Features, labels: np.ndarray) -> None:
        """Stochastic gradient steps with a rate per weight (sums of squared gradients)."""
        random = np.random.default_rng(55)
        seen_linear = np.full_like(self.linear, 1e-4)
        seen_factors = np.full_like(self.factors, 1e-4)
        # Both labels weigh the same.
        share = labels.mean()
        balance = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for _ in range(EPOCHS):
            for picked in np.array_split(random.permutation(len(labels)), max(1, len(labels) // BATCH)):
                pieces = [np.arange(features.bounds[r], features.bounds[r + 1]) for r in picked]
                lengths = np.array([len(p) for p in pieces])
                flat = np.concatenate(pieces)
                at, value = features.index[flat], features.value[flat]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                linear, total, squares = self.sums(at, value, bounds)
                margin = linear + 0.5 * (total**2 - squares).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]) * balance[picked]
                step = np.repeat(error / len(picked), lengths) * value
                row = np.repeat(np.arange(len(picked)), lengths)
                places, code = np.unique(at, return_inverse=True)
                g = np.bincount(code, step, len(places)) + 1e-6 * self.linear[places]
                seen_linear[places] += g * g
                self.linear[places] -= RATE * g / np.sqrt(seen_linear[places])
                slope = step[:, None] * (total[row] - self.factors[at] * value[:, None])
                for k in range(RANK):
                    g = np.bincount(code, slope[:, k], len(places)) + 1e-5 * self.factors[places, k]
                    seen_factors[places, k] += g * g
                    self.factors[places, k] -= RATE * g / np.sqrt(seen_factors[places, k])


def fit(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | None:
    """A machine fitted on the driver to a bounded sample of labelled rows."""
    allowed = remainder(FOLDS) != 0
    rows = training_rows(docs, labels, "quality", allowed, TRAINING_ROWS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Features(batch.column("text"))
            bounds = pa.array(found.bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("label"),
                    pa.ListArray.from_arrays(bounds, pa.array(found.index.astype(np.int16))),
                    pa.ListArray.from_arrays(bounds, pa.array(found.value.astype(np.float32))),
                ],
                names=["doc_id", "label", "at", "value"],
            )

    table = rows.mapInArrow(extract, "doc_id long, label int, at array<short>, value array<float>").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    answers = table.column("label").to_numpy().astype(float)
    if len(answers) == 0 or answers.min() == answers.max():
        return None
    features = Features(pa.array([], pa.string()))
    at = table.column("at").combine_chunks()
    features.index = at.flatten().to_numpy().astype(np.int64)
    features.value = table.column("value").combine_chunks().flatten().to_numpy().astype(float)
    features.bounds = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    machine = FactorisationMachine(features.width)
    machine.fit(features, answers)
    return machine


def score(docs: DataFrame, machine: FactorisationMachine | None) -> DataFrame:
    """All rows with their columns and ``score``."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, texts = np.full(batch.num_rows, 0.5), batch.column("text")
            for first, last in slices(texts, 1 << 20) if machine is not None else ():
                margin = machine.margin(Features(texts.slice(first, last - first)))
                scores[first:last] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"]
            )

    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (label 1 likelier when higher) and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (remainder(FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    scored = score(docs, fit(docs, labels))
    return scored.where(F.col("score") >= THRESHOLD).select(*docs.columns)
