"""Token ids of documents in binary shard files (operator 1).

Every text is encoded by a tokenizer file of the tokenizers library, an end id is appended, and the ids
of each document are compressed on their own with one shared zstandard dictionary. A shard file is

    magic "VLTK1", bytes per id (1 byte), sha256 of the dictionary (32 bytes),
    one zstandard frame per document, in ascending document order,
    index: document ids, frame offsets (one more than documents), id counts; each little-endian int64,
    number of documents (int64), position of the index (int64), magic "VLTK1"

so a document is read with one look at the index and one short read. The dictionary lies beside the
shards as ``<sha256>.dict``. The dictionary alone is trained on a sample: ``SAMPLE_DOCUMENTS`` documents
by expectation, those with the smallest hashes, at most ``SAMPLE_BYTES`` of ids of each. It has no effect
on what is read back.

Defined cases: null and empty texts hold the end id alone; a null doc_id is written as -1 with a flag
array of nulls and read back as null; rows with one doc_id are ordered by a hash of the text, then by
the text; an empty table writes no shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import posixpath
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltledger.llm.text_batch import Memo, distinct, hash_spans, slices, text_buffer
from voltledger.sources.staging import shared_folder

MAGIC = b"VLTK1"
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 2000
SAMPLE_BYTES = 32 << 10
LEAST_SAMPLE = 64
MEMO_PIECES = 2_000_000
LEVEL = 3

SHARDS = "path string, part int, documents long, ids long, bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, frame_bytes long"


# -- encoding ---------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo(np.uint32, MEMO_PIECES)


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
# First bytes of the white space beyond ASCII: U+0085 U+00A0, U+1680 U+180E, U+20xx, U+3000.
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PUNCTUATION = ~_WORD & ~_BLANK & (np.arange(256) > 0x20)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces that byte-level BPE encodes alike in the text and alone.

    Its pattern never joins across a single blank between other characters (a space opens the next
    piece, a line end stands alone), nor from a Latin letter to a punctuation mark. Texts that hold
    longer runs of white space, white space beyond ASCII or "<|" stay whole; the second result says
    which rows these are.
    """
    blank = _BLANK[data]
    before = np.concatenate([[False], blank[:-1]])
    after = np.concatenate([blank[1:], [False]])
    inner = np.ones(len(data), bool)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    inner[heads] = False
    before[heads], after[tails] = False, False
    single = (data == 0x20) | (data == 0x0A)
    odd = blank & (before | after | ~single)
    nxt = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    odd |= (data == 0x3C) & (nxt == 0x7C)
    foreign = np.flatnonzero(_FOREIGN[data])
    second = nxt[foreign]
    is_e2 = data[foreign] == 0xE2
    odd[foreign] |= np.where(is_e2, (second == 0x80) | (second == 0x81), True)
    odd_rows = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(odd)
    odd_rows[np.searchsorted(offsets, at, side="right") - 1] = True
    previous = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    cut = single | (_PUNCTUATION[data] & _LETTER[previous])
    cut &= inner
    cut &= ~np.repeat(odd_rows, np.diff(offsets))
    cut[heads] = True
    return np.flatnonzero(cut), odd_rows


def encode_column(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the column the ids of all its texts in a row and the bounds of each text.

    Texts are cut into pieces, the library encodes each distinct piece once, and the ids are put
    together again.
    """
    tokenizer, memo = _tokenizer(path), _memo(path)
    for first, last in slices(column):
        data, offsets = text_buffer(column.slice(first, last - first))
        if not len(data):
            yield np.empty(0, np.uint32), np.zeros(last - first + 1, np.int64)
            continue
        starts, _ = _pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, places, codes = distinct(hash_spans(data, starts, ends - starts))

        def compute(missing):
            texts = [data[starts[i] : ends[i]].tobytes().decode() for i in places[missing]]
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for one in ids for i in one), np.uint32, int(lengths.sum()))
            return flat, lengths

        rows = memo.rows_of(keys, compute)[codes]
        ids, piece_ends = memo.gather(rows)
        piece_ends = np.concatenate([[0], piece_ends])
        yield ids, piece_ends[np.searchsorted(starts, offsets)]


# -- files ------------------------------------------------------------------------------------------


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(path: str, data: bytes, attempt: str) -> None:
    """Put the whole file in place at once, whatever other attempts at it do."""
    folder, name = posixpath.split(path)
    system, place = _files(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/.{name}.{attempt}") as out:
        out.write(data)
    system.move(f"{place}/.{name}.{attempt}", f"{place}/{name}")


def _read(path: str) -> bytes:
    folder, name = posixpath.split(path)
    system, place = _files(folder)
    with system.open_input_file(f"{place}/{name}") as file:
        return file.read()


class ShardWriter:
    """One shard file, built frame by frame. A shard holds compressed ids only."""

    def __init__(self, dictionary: bytes, id_bytes: int):
        self.kind = "<u2" if id_bytes == 2 else "<u4"
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        self.out = io.BytesIO()
        self.out.write(MAGIC + bytes([id_bytes]) + hashlib.sha256(dictionary).digest())
        self.doc_ids, self.offsets, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.offsets.append(self.out.tell())
        self.counts.append(len(ids))
        self.out.write(self.compressor.compress(ids.astype(self.kind).tobytes()))

    def finish(self) -> bytes:
        at, n = self.out.tell(), len(self.doc_ids)
        known = np.array([d is not None for d in self.doc_ids], "<i8")
        doc_ids = np.array([-1 if d is None else d for d in self.doc_ids], "<i8")
        for column in (doc_ids, known, [*self.offsets, at], self.counts):
            self.out.write(np.asarray(column, "<i8").tobytes())
        self.out.write(struct.pack("<qq", n, at) + MAGIC)
        return self.out.getvalue()


class ShardReader:
    """Random access to the documents of one shard by its index."""

    def __init__(self, path: str):
        folder, name = posixpath.split(path)
        system, place = _files(folder)
        self.file = system.open_input_file(f"{place}/{name}")
        size = self.file.size()
        n, at = struct.unpack("<qq", self._at(size - 21, 16))
        if self._at(0, 5) != MAGIC or self._at(size - 5, 5) != MAGIC:
            raise ValueError(f"Not a token shard: {path}")
        self.kind = "<u2" if self._at(5, 1) == b"\2" else "<u4"
        self.dictionary_hash = self._at(6, 32).hex()
        index = np.frombuffer(self._at(at, size - 21 - at), "<i8")
        self.doc_ids, self.known, self.counts = index[:n], index[n : 2 * n] == 1, index[3 * n + 1 :]
        self.offsets = index[2 * n : 3 * n + 1]
        dictionary = _read(f"{folder}/{self.dictionary_hash}.dict")
        if hashlib.sha256(dictionary).hexdigest() != self.dictionary_hash:
            raise ValueError(f"The dictionary of {path} is damaged")
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=data)

    def _at(self, position: int, length: int) -> bytes:
        self.file.seek(position)
        return self.file.read(length)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        frame = self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        raw = self.decompressor.decompress(frame)
        return np.frombuffer(raw, self.kind).astype(np.uint32)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this doc_id, in file order."""
        return [self.ids(k) for k in np.flatnonzero((self.doc_ids == doc_id) & self.known)]


# -- jobs -------------------------------------------------------------------------------------------


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int) -> bytes:
    """The shared dictionary, from the ids of a bounded sample of documents, an eighth of their size at most;
    empty where the texts hold next to nothing."""
    total = docs.count()
    if not total:
        return b""
    share = min(1.0, SAMPLE_DOCUMENTS / total)
    limit = int(share * (1 << 30))
    kind = "<u2" if id_bytes == 2 else "<u4"
    picked = docs.select("doc_id", "text").where(
        F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < limit
    )

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bounds in encode_column(batch.column("text"), tokenizer_path):
                parts = [
                    ids[a:b][: SAMPLE_BYTES // id_bytes].astype(kind).tobytes()
                    for a, b in zip(bounds[:-1], bounds[1:])
                    if a < b
                ]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(parts, pa.binary())})

    # Twice the expectation is never passed but by rows that share one doc_id.
    samples = picked.mapInArrow(serialize, "ids binary").orderBy("ids").limit(2 * SAMPLE_DOCUMENTS)
    parts = [bytes(row.ids) for row in samples.collect()]
    total = sum(map(len, parts))
    if total < LEAST_SAMPLE:
        return b""
    size = min(DICTIONARY_BYTES, max(total // 8, 256))
    piece = min(4096, max(64, total // 16 // 8 * 8))
    pieces = [p[i : i + piece] for p in parts for i in range(0, len(p), piece)]
    try:
        return zstandard.train_dictionary(size, pieces, k=min(256, size // 4), d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]  # too few to train on: their own end serves as one


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0
) -> DataFrame:
    """Write the ids of all texts to shards in ascending doc_id order and return one row per shard:
    its path, the number of its documents and ids, and its size."""
    id_bytes = 2 if max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_bytes)
    _write(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict", dictionary, "driver")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, ids_written = ShardWriter(dictionary, id_bytes), 0
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for ids, bounds in encode_column(batch.column("text"), tokenizer_path):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    writer.add(next(names), np.concatenate([ids[a:b], tail]))
                ids_written += len(ids) + len(bounds) - 1
        if not writer.counts:
            return
        data, part = writer.finish(), context.partitionId()
        path = f"{folder}/shard-{part:06d}.tok"
        _write(path, data, str(context.taskAttemptId()))
        row = [path, part, len(writer.counts), ids_written, len(data)]
        names = ("path", "part", "documents", "ids", "bytes")
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    order = F.xxhash64("text")
    placed = docs.select("doc_id", "text", order.alias("_h")).repartitionByRange("doc_id", "_h")
    placed = placed.sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    shards = f"{folder}/shards"
    placed.mapInArrow(encode, SHARDS).write.parquet(shards)
    return docs.sparkSession.read.schema(SHARDS).parquet(shards)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all documents before it),
    n_tokens and the checksum of its ids. Only one number per shard passes through the driver."""
    spark = shards.sparkSession
    listed = shards.orderBy("part").select("path", "ids").collect()
    starts = accumulate((row.ids for row in listed), initial=0)
    begin = {row.path: start for row, start in zip(listed, starts)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                shard = ShardReader(path)
                crcs = (zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard)))
                start = begin[path] + np.cumsum(shard.counts) - shard.counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=~shard.known),
                        pa.array(start, pa.int64()),
                        pa.array(shard.counts, pa.int64()),
                        pa.array(np.fromiter(crcs, np.int64, len(shard))),
                        pa.array([posixpath.basename(path)] * len(shard)),
                        pa.array(np.diff(shard.offsets), pa.int64()),
                    ],
                    names=[f.split()[0] for f in ROWS.split(", ")],
                )

    files = spark.createDataFrame([(row.path,) for row in listed], "path string")
    return files.repartition(max(1, len(listed))).mapInArrow(decode, ROWS)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None):
    """Write all documents and read them back."""
    import uuid

    folder = folder or f"{shared_folder(docs.sparkSession)}/voltledger/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_token_shards(write_token_shards(docs, tokenizer_path, folder, end_id))
