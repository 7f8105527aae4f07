"""Alignment of the tokens of two tokenizers, and how often ids are linked (operator 12).

Tokens of both sides are spans of bytes of the same text. Per batch, ``pandas.merge_asof`` keyed by document
finds for each token start the covering token of the other side; the union of both directions is all pairs
of tokens that overlap (of two overlapping spans one begins inside the other). Places where tokens of both
sides end cut the tokens into groups.

How often two ids are linked in the whole corpus is needed for each link of each document, which would
be one row per link to shuffle. Instead the links of a block of up to 16 MB of text are numbered once per
distinct pair of ids, documents hold these numbers, and only the distinct pairs of a block are counted,
joined with the corpus-wide counts, and brought together with their block again:

    documents -> per document (block, numbers of its pairs) and per block (pair, links)    written once
    pairs     -> sum over blocks -> highest count of each id of side B
    (block, pair) x counts -> cogrouped by block with the documents of the block

No group holds more than a block, and a pair that occurs everywhere has one row per block.

Side A is a byte-level tokenizer file, side B a SentencePiece model; both encode the text with a space
before it, and special tokens in texts are plain text.

Defined cases: null and empty texts, and texts whose tokens do not spell them on both sides (a text with
U+2581, which side B takes for a blank), have no tokens, groups or links: zeros and '' for the hash. Rows with
one doc_id, or none, are each done by themselves; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voltledger.llm import piece_bpe
from voltledger.llm.bpe import _byte_letters
from voltledger.llm.text_batch import Memo, distinct, hash_spans, ranges, slices, text_buffer
from voltledger.llm.token_output import _pieces
from voltledger.sources.staging import Staging

BLOCK_BYTES = 16 << 20
PART_BYTES = 512 << 10
MEMO_PIECES = 1_000_000
#: A pair of ids as one number; with a text's place in its part before it, they sort as one number too.
SHIFT = 20
PAIR = (1 << 2 * SHIFT) - 1

PARTS = (
    "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "numbers binary, times binary, pairs array<long>, links array<long>"
)
ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


# -- side A -----------------------------------------------------------------------------------------


class ByteSide:
    """A byte-level tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << SHIFT:
            raise ValueError("Ids beyond 20 bits!")
        self.library.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(_byte_letters())}
        self.raw = np.full(self.library.get_vocab_size(), b"", object)
        for text, i in self.library.get_vocab().items():
            known = all(c in letters for c in text)
            self.raw[i] = bytes(letters[c] for c in text) if known else text.encode()
        self.length = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.memo = Memo(np.uint32, MEMO_PIECES)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the bounds of each; pieces that occur often are encoded once."""
        starts, _ = _pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, places, codes = distinct(hash_spans(data, starts, ends - starts))

        def compute(missing):
            texts = [data[starts[i] : ends[i]].tobytes().decode() for i in places[missing]]
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for one in ids for i in one), np.uint32, int(lengths.sum())), lengths

        ids, piece_ends = self.memo.gather(self.memo.rows_of(keys, compute)[codes])
        return ids, np.concatenate([[0], piece_ends])[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def byte_side(path: str) -> ByteSide:
    return ByteSide(path)


# -- tokens, links and groups of a part -------------------------------------------------------------


@dataclass
class Aligned:
    """Tokens of texts that have any: ids, the text and the group of each; links as places of tokens.

    Groups are numbered from 0 in each text; tokens and links are in the order of the texts.
    """

    a_ids: np.ndarray
    a_doc: np.ndarray
    a_group: np.ndarray
    b_ids: np.ndarray
    b_doc: np.ndarray
    b_group: np.ndarray
    groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(column: pa.Array, path_a: str, path_b: str) -> Aligned:
    """The tokens of all texts of a part, linked and grouped."""
    a_side = byte_side(path_a)
    b_side, _ = piece_bpe.load(path_b)
    rows = len(column)
    # Side B puts the space before the text itself.
    b_ids, b_bounds = _concatenated(piece_bpe.encode_column(column, path_b))
    full = pc.fill_null(pc.greater(pc.binary_length(column), 0), False)
    spaced = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")), "")
    data, offsets = text_buffer(spaced)
    if not len(data):
        none = np.empty(0, np.int64)
        return Aligned(*(none,) * 6, np.zeros(rows, np.int64), none, none)
    a_ids, a_bounds = a_side.encode(data, offsets)

    a_doc = np.repeat(np.arange(rows), np.diff(a_bounds))
    b_doc = np.repeat(np.arange(rows), np.diff(b_bounds))
    spelled = np.ones(rows, bool)
    for r in range(rows):
        text = data[offsets[r] : offsets[r + 1]].tobytes()
        own_a = a_side.raw[a_ids[a_bounds[r] : a_bounds[r + 1]]].tolist()
        own_b = b_side.raw[b_ids[b_bounds[r] : b_bounds[r + 1]]].tolist()
        spelled[r] = b"".join(own_a) == text == b"".join(own_b)
    keep_a, keep_b = spelled[a_doc], spelled[b_doc]
    a_ids, a_doc = a_ids[keep_a].astype(np.int64), a_doc[keep_a]
    b_ids, b_doc = b_ids[keep_b].astype(np.int64), b_doc[keep_b]

    # Spans on one axis, one text after the other.
    a_end, b_end = np.cumsum(a_side.length[a_ids]), np.cumsum(b_side.raw_length[b_ids])
    a_start, b_start = a_end - a_side.length[a_ids], b_end - b_side.raw_length[b_ids]
    link_a, link_b = _links(a_start, a_doc, b_start, b_doc)

    # A token's group is the number of common ends before its own end.
    at = np.minimum(np.searchsorted(b_end, a_end), max(len(b_end) - 1, 0))
    a_cut = b_end[at] == a_end
    b_cut = np.zeros(len(b_end), bool)
    b_cut[at[a_cut]] = True
    groups = np.bincount(a_doc[a_cut], minlength=rows)
    base = np.cumsum(groups) - groups
    a_group = np.cumsum(a_cut) - a_cut - base[a_doc]
    b_group = np.cumsum(b_cut) - b_cut - base[b_doc]
    return Aligned(a_ids, a_doc, a_group, b_ids, b_doc, b_group, groups, link_a, link_b)


def _concatenated(parts) -> tuple[np.ndarray, np.ndarray]:
    ids, bounds, total = [], [np.zeros(1, np.int64)], 0
    for own, edges in parts:
        ids.append(own)
        bounds.append(edges[1:] + total)
        total += len(own)
    return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate(bounds)


def _links(a_start, a_doc, b_start, b_doc) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of tokens whose spans overlap, each once."""
    a = pd.DataFrame({"doc": a_doc, "start": a_start, "a": np.arange(len(a_doc))})
    b = pd.DataFrame({"doc": b_doc, "start": b_start, "b": np.arange(len(b_doc))})
    covered_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
    covered_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
    # Tokens that start together cover each other: the union takes them from the first direction.
    other = np.flatnonzero(a_start[covered_b] != b_start)
    return np.append(a["a"].to_numpy(), covered_b[other]), np.append(covered_a, other)


def group_texts(found: Aligned, size: int) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
    rows = len(found.groups)
    tables = _decimals(size)
    parts, docs, orders = [], [], []
    for ids, doc, group, side, last in (
        (found.a_ids, found.a_doc, found.a_group, 0, 1),
        (found.b_ids, found.b_doc, found.b_group, 1, 2),
    ):
        ends = np.ones(len(ids), bool)
        ends[:-1] = (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
        parts.append(np.where(ends, tables[last][ids], tables[0][ids]))
        docs.append(doc)
        base = np.cumsum(found.groups) - found.groups
        orders.append(2 * (base[doc] + group) + side)
    order = np.argsort(np.concatenate(orders), kind="stable")
    texts = np.concatenate(parts)[order].tolist()
    edges = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(docs), minlength=rows))])
    return ["".join(texts[a:b])[:-1] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, ...]:
    """The decimal of each id with each mark that may follow it."""
    return tuple(np.array([f"{i}{mark}" for i in range(size)], object) for mark in ",|;")


# -- numbers as bytes -------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on in groups of seven bits, the top bit set where more follow."""
    if not len(values):
        return b""
    if values.max() < 128:
        return values.astype(np.uint8).tobytes()
    length = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        length += values >= (np.int64(1) << bits)
    step = ranges(np.zeros(len(values), np.int64), length)
    out = (np.repeat(values, length) >> (7 * step)) & 127
    out[step + 1 < np.repeat(length, length)] |= 128
    return out.astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    step = ranges(np.zeros(len(ends), np.int64), ends - starts)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * step), starts)


# -- Spark ------------------------------------------------------------------------------------------


def _parts(column: pa.Array, path_a: str, path_b: str):
    """Per part of a block its first row and its tokens."""
    for first, last in slices(column, PART_BYTES):
        yield first, align(column.slice(first, last - first), path_a, path_b)


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The rows of PARTS: one per document; the first of a block also holds the block's pairs."""
    schema = pa.schema(
        [
            ("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
            ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
            ("numbers", pa.binary()), ("times", pa.binary()),
            ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
        ]
    )

    def block(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        rows = len(column)
        size = max(len(byte_side(path_a).raw), piece_bpe.load(path_b)[0].size)
        counts = np.zeros((4, rows), np.int64)
        hashes, entries = [], []
        for first, found in _parts(column, path_a, path_b):
            here = slice(first, first + len(found.groups))
            link_doc = found.a_doc[found.link_a]
            for k, doc in enumerate((found.a_doc, found.b_doc, None, link_doc)):
                counts[k, here] = (
                    found.groups if doc is None else np.bincount(doc, minlength=len(found.groups))
                )
            for text in group_texts(found, size):
                hashes.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            key = found.a_ids[found.link_a] << SHIFT | found.b_ids[found.link_b]
            key = np.sort(link_doc << 2 * SHIFT | key)
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            times = np.diff(np.append(opens, len(key)))
            entries.append(((key[opens] >> 2 * SHIFT) + first, key[opens] & PAIR, times))
        doc, key, times = (np.concatenate(x) for x in zip(*entries))
        pairs, _, number = distinct(key)
        links = np.bincount(number, weights=times, minlength=len(pairs)).astype(np.int64)
        edges = np.searchsorted(doc, np.arange(rows + 1))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        # Numbers ascend within a document: the steps between them are small.
        numbers = [pack(np.diff(number[a:b], prepend=0)) for a, b in spans]
        empty = [[]] * (rows - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex] * rows),
                ids.cast(pa.int64()),
                *(pa.array(c) for c in counts),
                pa.array(hashes),
                pa.array(numbers, pa.binary()),
                pa.array([pack(times[a:b]) for a, b in spans], pa.binary()),
                pa.array([pairs, *empty], pa.list_(pa.int64())),
                pa.array([links, *empty], pa.list_(pa.int64())),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for first, last in slices(column, BLOCK_BYTES):
                yield block(ids.slice(first, last - first), column.slice(first, last - first))

    return docs.select("doc_id", "text").mapInArrow(run, PARTS)


def _block_pairs(parts: DataFrame) -> DataFrame:
    """block, number (of the pair in its block), pair, links (of the block)."""
    return (
        parts.where(F.size("pairs") > 0)
        .select("block", F.posexplode(F.arrays_zip("pairs", "links")).alias("number", "it"))
        .select("block", "number", F.col("it.pairs").alias("pair"), F.col("it.links").alias("links"))
    )


def _counts(block_pairs: DataFrame) -> DataFrame:
    """pair, count (links of the pair in the corpus), best (no pair of this id of side B has more)."""
    counts = block_pairs.groupBy("pair").agg(F.sum("links").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(key, parts: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a block's documents with the corpus-wide counts of their links."""
    number = known.column("number").to_numpy()
    count = np.zeros(len(number), np.int64)
    best = np.zeros(len(number), np.int64)
    count[number] = known.column("count").to_numpy()
    best[number] = known.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for numbers, times in zip(parts.column("numbers").to_pylist(), parts.column("times").to_pylist()):
        own, n = np.cumsum(unpack(numbers)), unpack(times)
        n_best.append(int((best[own] * n).sum()))
        count_sum.append(int((count[own] * n).sum()))
    columns = {name: parts.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(
        {
            **columns,
            "n_best": pa.array(n_best, pa.int64()),
            "count_sum": pa.array(count_sum, pa.int64()),
            "groups_sha256": parts.column("groups_sha256"),
        }
    )


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its tokens, groups and links, and how often its linked ids are linked corpus-wide."""
    parts = Staging(docs.sparkSession, "alignment").write(_blocks(docs, path_a, path_b))
    block_pairs = _block_pairs(parts)
    known = block_pairs.join(_counts(block_pairs), "pair").select(
        F.col("block").alias("of_block"), "number", "count", "best"
    )
    rows = parts.drop("pairs", "links").groupBy("block")
    return rows.cogroup(known.groupBy("of_block")).applyInArrow(_summed, ROWS)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How often each id of side A and each of side B are linked in the corpus: a_id, b_id, links."""
    parts = _block_pairs(_blocks(docs, path_a, path_b))
    return parts.groupBy("pair").agg(F.sum("links").alias("links")).select(
        F.shiftright("pair", SHIFT).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"),
        "links",
    )


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and ``groups``, the aligned groups of its tokens as ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(byte_side(path_a).raw), piece_bpe.load(path_b)[0].size)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, found in _parts(batch.column("text"), path_a, path_b):
                texts = group_texts(found, size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array(texts, pa.string())],
                    names=["doc_id", "groups"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups string")
