"""Similarity join on word n-grams by MinHash banding (operator 10).

A document's set is that of its five-word shingles (of all its words where it has one to four). Two
documents are linked when the Jaccard similarity of their sets is 0.8 or more. Documents with the same
set form one class and one of them stands for all. Representatives meet where all rows of a band
agree; ``bands_for`` takes the fewest bands that find a pair at the threshold with the target
probability, and every pair that meets is verified on the full sets. A pair is verified in the first
band where it meets. A crowded bucket is cut into chunks and each pair of chunks is a unit of work of
its own, in which links are counted and not listed, so neither a task nor a table holds all pairs of a
group.

Defined cases: null and empty texts have no shingles and link with nothing; rows with a null doc_id link
with nothing and have no class; rows with the same doc_id and different texts are documents of their own,
told apart by their texts; equal rows count as copies of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltledger.llm.components import components
from voltledger.llm.text_batch import shingle_sets
from voltledger.sources.staging import Staging

THRESHOLD = (4, 5)
ROWS_PER_BAND = 5
TARGET_RECALL = 0.99999
CHUNK = 256

_CLASSED = "doc_id long, text_hash long, set_key string, shingles int, bands array<long>"
_FOUND = "node long, links long, root long"


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` minima that a pair of this similarity shares one of."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(THRESHOLD[0] / THRESHOLD[1], ROWS_PER_BAND, TARGET_RECALL)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    a = random.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, count, dtype=np.uint64)


def band_values(shingles: np.ndarray) -> np.ndarray:
    """One value per band: a hash of its minima."""
    a, b = _permutations(BANDS * ROWS_PER_BAND)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        mixed = part * a + b
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, mixed.min(axis=0))
    bands = least.reshape(BANDS, ROWS_PER_BAND)
    value = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS_PER_BAND):
        value = (value ^ bands[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
    return value.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, bands = [], [], []
        for found in shingle_sets(batch.column("text")):
            if len(found):
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest())
                bands.append(band_values(found))
            else:
                keys.append(None)
                bands.append(None)
            sizes.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("text_hash"),
                pa.array(keys, pa.string()),
                pa.array(sizes, pa.int32()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_hash", "set_key", "shingles", "bands"],
        )


def _similar(shared: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    part, whole = THRESHOLD
    return whole * shared >= part * (one + other - shared)


class _Group:
    """The representatives that share a bucket, or two chunks of one."""

    def __init__(self, band: int, crosses: bool, rows: list[tuple]):
        seen, kept = set(), []
        for row in rows:
            if row[0] not in seen:
                seen.add(row[0])
                kept.append(row)
        self.band, self.crosses = band, crosses
        self.node = [r[0] for r in kept]
        self.chunk = np.array([r[1] for r in kept])
        self.weight = np.array([r[2] for r in kept], np.int64)
        self.bands = np.array([r[3] for r in kept], np.int64)
        self.sets = [r[4] for r in kept]
        self.size = np.array([len(s) for s in self.sets], np.int64)

    def _candidates(self, i: int, later: np.ndarray) -> np.ndarray:
        """Which of these rows meet row i here and in no earlier band."""
        if self.band:
            earlier = self.bands[later, : self.band] == self.bands[i, : self.band]
            later = later[~earlier.any(axis=1)]
        part, whole = THRESHOLD
        size, own = self.size[later], self.size[i]
        later = later[(whole * size >= part * own) & (whole * own >= part * size)]
        if self.crosses:
            later = later[self.chunk[later] != self.chunk[i]]
        return later

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        n = len(self.node)
        postings = None
        for i in range(n - 1):
            later = self._candidates(i, np.arange(i + 1, n))
            if not len(later):
                continue
            if n <= 8:
                shared = np.array(
                    [len(np.intersect1d(self.sets[i], self.sets[j], True)) for j in later]
                )
            else:
                if postings is None:
                    values = np.concatenate(self.sets)
                    owner = np.repeat(np.arange(n), self.size)
                    order = np.argsort(values, kind="stable")
                    postings = values[order], owner[order]
                values, owner = postings
                low = np.searchsorted(values, self.sets[i], side="left")
                high = np.searchsorted(values, self.sets[i], side="right")
                shared = np.zeros(n, np.int64)
                for at in range(0, len(low), 4096):
                    a, b = low[at : at + 4096], high[at : at + 4096]
                    count = b - a
                    start = np.repeat(a - (np.cumsum(count) - count), count)
                    hit = owner[start + np.arange(int(count.sum()))]
                    shared += np.bincount(hit, minlength=n)
                shared = shared[later]
            linked = later[_similar(shared, self.size[later], self.size[i])]
            if len(linked):
                yield i, linked

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(node, weight of its partners here, smallest node it hangs together with here)."""
        n = len(self.node)
        total, parent = np.zeros(n, np.int64), list(range(n))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, linked in self.links():
            total[i] += self.weight[linked].sum()
            total[linked] += self.weight[i]
            for j in linked.tolist():
                a, b = root(i), root(j)
                if a != b:
                    low, high = (a, b) if self.node[a] < self.node[b] else (b, a)
                    parent[high] = low
        for i in np.flatnonzero(total):
            yield self.node[i], int(total[i]), self.node[root(i)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, bucket, low, high); one group may span batches."""
    key, rows = None, []

    def finished() -> pa.RecordBatch:
        found = list(_Group(key[0], key[2] != key[3], rows).found())
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"]
        )

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("band", "bucket", "low", "high")))
        nodes, chunks, weights = (batch.column(c).to_pylist() for c in ("node", "chunk", "weight"))
        bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        sets = shingle_sets(batch.column("text"))
        for i, (this, found) in enumerate(zip(keys, sets)):
            if this != key:
                if len(rows) > 1:
                    yield finished()
                key, rows = this, []
            rows.append((nodes[i], chunks[i], weights[i], bands[i], found))
    if len(rows) > 1:
        yield finished()


def _judged(docs: DataFrame, staging: Staging) -> DataFrame:
    """The rows of ``ngram_join`` with the hash of their text. A node is a doc_id with a text: the smallest
    of those that have the set."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    node = F.xxhash64(F.col("doc_id").cast("long"), F.col("text_hash")).alias("node")
    signed = staging.write(hashed.mapInArrow(_signatures, _CLASSED))
    named = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = staging.write(
        named.groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("first"), F.count("*").alias("weight"))
        .select("set_key", "first.doc_id", "first.text_hash", "first.bands", "weight")
        .select("*", node)
    )
    placed = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowded = placed.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(crowded, ["band", "bucket"])
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    met = met.withColumn("chunk", F.pmod("node", chunks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.select(
        "node", "band", "bucket", "chunk",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
    )
    met = staging.write(met)
    texts = hashed.select(node, "text").join(met.select("node").distinct(), "node")
    members = met.join(classes.select("node", "weight", "bands"), "node")
    work = members.join(texts, "node").select(
        "band", "bucket", "low", "high", "node", "chunk", "weight", "bands", "text"
    )
    keys = ["band", "bucket", "low", "high"]
    found = staging.write(
        work.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_verify, _FOUND)
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), staging)
    own = F.struct("doc_id", "text_hash")
    joined = classes.select("node", "doc_id", "text_hash").join(joined, "node")
    first = joined.groupBy("component").agg(F.min(own).alias("first"))
    known = (
        classes.select("set_key", "node", "doc_id", "text_hash", "weight")
        .join(links, "node", "left")
        .join(joined.select("node", "component"), "node", "left")
        .join(first, "component", "left")
        .select(
            "set_key",
            F.col("doc_id").alias("class_id"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("first", own).alias("first"),
        )
    )
    key = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    rows = signed.select("doc_id", "text_hash", key.alias("set_key")).join(known, "set_key", "left")
    stands = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.when(F.col("first").isNull(), F.col("doc_id").isNotNull()).otherwise(stands).alias("kept"),
        "text_hash",
    )


def ngram_join(docs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id with the same set), n_links
    (other rows linked directly, copies included), component_id (smallest doc_id reachable by links,
    itself included) and kept (whether the row, or one equal to it, stands for its component)."""
    return _judged(docs, staging or Staging(docs.sparkSession, "ngram-join")).drop("text_hash")


def keep_one(docs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """One document of each component, with its columns: that with the smallest doc_id. Rows without
    doc_id stay; of rows equal in doc_id and text a single one does."""
    key = ["doc_id", "text_hash"]
    kept = _judged(docs, staging or Staging(docs.sparkSession, "ngram-join")).where("kept")
    named = docs.select(*(F.col(c).alias(f"_doc_{c}") for c in docs.columns),
                        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    chosen = named.join(kept.select(*key).distinct(), key).dropDuplicates(key)
    chosen = chosen.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns))
    return chosen.unionByName(docs.where("doc_id IS NULL"))
