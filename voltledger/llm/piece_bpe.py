"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 13).

The symbols of all distinct words of a slice lie in one flat array. A round takes, per word, the smallest
rank among its neighbouring pairs (a segmented minimum), merges all places of that rank from the left at
once, and compacts the array; words without a pair that merges leave it. Rounds end when none is left.

Merging all places at once equals merging one after the other as long as no merge makes a pair of the same
or a smaller rank. Where one does, the round stops in that word after this merge. The pieces of several
blanks share the last rank; runs of blanks are therefore merged from the left in one go once all else is
merged, instead of one blank a round.

Words end where no piece holds the two neighbouring characters, so they are merged apart exactly.
Characters without a piece become byte tokens.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text is a blank,
as in the library; other columns are ignored; one row comes out per row that goes in, repeated rows, null
and repeated doc_ids included; an empty table gives no rows. Memory is bounded by a slice of 4 MB of text, or
by one longer text.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voltledger.llm.text_batch import Memo, distinct, hash_spans, ranges, slices, text_buffer

MEMO_WORDS = 500_000
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BLANK = "▁"
NEVER = np.int64(1) << 40
_BLANK_BYTES = BLANK.encode()


class PieceBpe:
    """A SentencePiece model file of kind BPE with byte fallback, without text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        kinds = [
            "byte" if library.is_byte(i)
            else "control" if library.is_control(i) or library.is_unknown(i)
            else "unused" if library.is_unused(i)
            else "normal"
            for i in range(self.size)
        ]
        texts = [library.id_to_piece(i) for i in range(self.size)]
        self._refuse_other_kinds(library, kinds)
        vocab = {t: i for i, t in enumerate(texts) if kinds[i] == "normal"}
        self.byte_id = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)

        # Single characters that only occur inside pieces get ids beyond the vocabulary.
        chars = sorted({c for t in vocab for c in t})
        symbol = dict(vocab)
        for c in chars:
            symbol.setdefault(c, self.size + ord(c))
        self.char = np.array([ord(c) for c in chars], np.int64)
        self.char_symbol = np.array([symbol[c] for c in chars], np.int64)
        self.width = np.int64(max(symbol.values()) + 1)

        scores = [library.get_score(i) for i in vocab.values()]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self._find_runs(vocab, scores)
        keys, ranks, made = [], [], []
        for (text, i), score in zip(vocab.items(), scores):
            if i in self.run_set:
                continue
            for cut in range(1, len(text)):
                a, b = symbol.get(text[:cut]), symbol.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    ranks.append(order[score])
                    made.append(i)
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[by_key]
        self.ranks = np.array(ranks, np.int64)[by_key]
        self.made = np.array(made, np.int64)[by_key]

        # Pairs of ASCII characters that some piece holds side by side (a blank counts as a space).
        together = np.zeros((256, 256), bool)
        together[128:, :] = together[:, 128:] = True
        for t in vocab:
            flat = t.replace(BLANK, " ")
            for a, b in zip(flat, flat[1:]):
                if max(a, b) < "\x80":
                    together[ord(a), ord(b)] = True
        self.together = together

        raw = [
            bytes([int(t[3:5], 16)]) if k == "byte"
            else b"" if k == "control" and i != library.unk_id()
            else " ⁇ ".encode() if k == "control"
            else t.replace(BLANK, " ").encode()
            for i, (t, k) in enumerate(zip(texts, kinds))
        ]
        self.raw = np.array(raw, object)
        self.raw_length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.is_control = np.array([k == "control" for k in kinds])

    @staticmethod
    def _refuse_other_kinds(library, kinds: list[str]) -> None:
        probe = "".join(map(chr, [*range(1, 0x3200), *range(0xF900, 0x10000)])) + "  x  "
        plain = BLANK + probe.replace(" ", BLANK)
        if library.normalize(probe) != plain or "unused" in kinds or "byte" not in kinds:
            raise ValueError("Only models without normalisation, with byte fallback and without unused pieces!")

    def _find_runs(self, vocab: dict[str, int], scores: list[float]) -> None:
        """The pieces of several blanks, if they alone share the worst score and no other piece holds two."""
        made = [(t, i, s) for (t, i), s in zip(vocab.items(), scores) if len(t) > 1]
        last = min(s for _, _, s in made)
        worst = {t: i for t, i, s in made if s == last}
        apart = all(not t.strip(BLANK) for t in worst)
        others = any(BLANK * 2 in t and t not in worst for t in vocab)
        self.blank_symbol = vocab.get(BLANK, -1)
        self.runs = {len(t): i for t, i in worst.items()} if apart and not others else {}
        self.run_set = set(self.runs.values())
        self.of_run: dict[int, np.ndarray] = {}

    def _run(self, length: int) -> np.ndarray:
        """Ids of a run of blanks: its pairs have one rank, so the leftmost that has a piece merges first."""
        if length not in self.of_run:
            sizes: list[int] = []
            for _ in range(length):
                sizes.append(1)
                while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                    sizes[-2:] = [sizes[-2] + sizes[-1]]
            if len(self.of_run) > 1000:
                self.of_run.clear()
            ids = {**self.runs, 1: self.blank_symbol}
            self.of_run[length] = np.array([ids[n] for n in sizes], np.int64)
        return self.of_run[length]

    # -- merging ------------------------------------------------------------------------------------

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place among the pairs of each two symbols; NEVER where they do not merge."""
        key = np.where((a >= 0) & (b >= 0), a * self.width + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), at

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all words (ascending word numbers); the symbols left and where each began."""
        place = np.arange(len(symbols))
        done = []
        rank = np.full(len(symbols), NEVER)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], _ = self._look_up(symbols[same], symbols[same + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(symbols)))
            least = np.repeat(least, lengths)
            ended = least == NEVER
            if ended.any():
                done.append((place[ended], symbols[ended]))
                keep = ~ended
                symbols, word, place = symbols[keep], word[keep], place[keep]
                rank, least = rank[keep], least[keep]
                if not len(symbols):
                    break
            at = self._leftmost(np.flatnonzero(rank == least))
            _, pair = self._look_up(symbols[at], symbols[at + 1])
            new = self.made[pair]
            at, new = self._until_trouble(symbols, word, at, new, least[at])
            symbols[at] = new
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, word, place, rank = symbols[keep], word[keep], place[keep], rank[keep]
            near = np.unique(np.concatenate([moved[moved > 0] - 1, moved]))
            rank[near] = NEVER
            near = near[near + 1 < len(symbols)]
            near = near[word[near] == word[near + 1]]
            rank[near], _ = self._look_up(symbols[near], symbols[near + 1])
        if not done:
            return symbols, place
        place, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbols[order], place[order]

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of places that overlap their neighbour, every second one from the left."""
        new_run = np.append(True, np.diff(hit) != 1)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        return hit[(np.arange(len(hit)) - run_start) % 2 == 0]

    def _until_trouble(self, symbols, word, at, new, least):
        """The merges of each word up to the first that makes a pair of the same or a smaller rank."""
        has_left = at > 0
        left = np.maximum(at - 1, 0)
        has_left &= word[left] == word[at]
        before = symbols[left].copy()
        joined = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
        before[joined] = new[joined - 1]
        right = np.minimum(at + 2, len(symbols) - 1)
        has_right = (at + 2 < len(symbols)) & (word[right] == word[at])
        bad = has_left & (self._look_up(before, new)[0] <= least)
        bad |= has_right & (self._look_up(new, symbols[right])[0] <= least)
        if not bad.any():
            return at, new
        # Merges that come after the first bad one of their word wait.
        bad_before = np.cumsum(bad) - bad
        owner = word[at]
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        base = np.repeat(bad_before[start], np.diff(np.append(start, len(at))))
        keep = bad_before == base
        return at[keep], new[keep]

    def _join_blanks(self, symbols, place, word):
        """Runs of blanks that are left become pieces of several blanks."""
        if not self.runs:
            return symbols, place
        blank = symbols == self.blank_symbol
        owner = word[place]
        inner = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
        if not inner.any():
            return symbols, place
        inner = np.concatenate([[False], inner, [False]])
        opens = np.flatnonzero(~inner[:-1] & inner[1:])
        ends = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
        keep = np.ones(len(symbols), bool)
        out = symbols.copy()
        for a, b in zip(opens.tolist(), ends.tolist()):
            ids = self._run(b - a)
            out[a : a + len(ids)] = ids
            keep[a + len(ids) : b] = False
        # All symbols of a run lie in one word, so the first places can stand for them.
        return out[keep], place[keep]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of the words (spans of UTF-8 bytes) one after the other, and the number of each word's."""
        lengths = ends - starts
        flat = data[ranges(starts, lengths)]
        code = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        code[code == 0x20] = ord(BLANK)
        word = np.repeat(np.arange(len(starts)), lengths)[(flat & 0xC0) != 0x80]
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        symbols = np.where(self.char[at] == code, self.char_symbol[at], -1)
        left, place = self.merge(symbols, word)
        left, place = self._join_blanks(left, place, word)
        owner = word[place]
        bare = (left < 0) | (left >= self.size)
        if not bare.any():
            return left, np.bincount(owner, minlength=len(starts))
        # Characters without a piece: one token for each of their bytes.
        spelled = [chr(c).encode() for c in code[place[bare]]]
        count = np.ones(len(left), np.int64)
        count[bare] = [len(s) for s in spelled]
        ids = np.repeat(left, count)
        ids[np.repeat(bare, count)] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(np.repeat(owner, count), minlength=len(starts))

    # -- decoding -----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids: pieces side by side without the blank before the first."""
        ids = np.asarray(ids, np.int64)
        if not self.is_control[ids].any():
            joined = self._joined(ids)
            if joined[:1] == b" " and not self.is_byte[ids[0]]:
                joined = joined[1:]
            try:
                return joined.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_by_runs(ids)

    def _joined(self, ids: np.ndarray) -> bytes:
        return self.raw_flat[ranges(self.raw_start[ids], self.raw_length[ids])].tobytes()

    def _decode_by_runs(self, ids: np.ndarray) -> str:
        """Byte tokens that follow each other make characters; one that fits none is U+FFFD."""
        out, opening = [], True
        cuts = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        for part in np.split(ids, cuts):
            if len(part) and self.is_byte[part[0]]:
                out.append(self._joined(part).decode(errors="one_mark_per_byte"))
                opening = False
                continue
            for i in part.tolist():
                text = self.raw[i].decode()
                if opening and text:
                    opening = False
                    if not self.is_control[i]:
                        text = text.removeprefix(" ")
                out.append(text)
        return "".join(out)


def _one_mark(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("one_mark_per_byte", _one_mark)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceBpe, Memo]:
    return PieceBpe(path), Memo(np.uint32, MEMO_WORDS)


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each that is not empty, U+2581 as a space."""
    data, offsets = text_buffer(column)
    if len(data) and _BLANK_BYTES in data.tobytes():
        data, offsets = text_buffer(pc.replace_substring(column, BLANK, " "))
    full = offsets[:-1] < offsets[1:]
    data = np.insert(data, offsets[:-1][full], 0x20)
    return data, offsets + np.concatenate([[0], np.cumsum(full)])


def encode_column(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the column the ids of all its texts in a row and the bounds of each text."""
    model, memo = load(path)
    for first, last in slices(column):
        data, offsets = _spaced(column.slice(first, last - first))
        if not len(data):
            yield np.empty(0, np.uint32), np.zeros(last - first + 1, np.int64)
            continue
        cut = np.append(True, ~model.together[data[:-1], data[1:]])
        cut[1:] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys, places, codes = distinct(hash_spans(data, starts, ends - starts))

        def compute(missing):
            which = places[missing]
            return model.encode_words(data, starts[which], ends[which])

        rows = memo.rows_of(keys, compute)[codes]
        ids, word_ends = memo.gather(rows)
        yield ids, np.concatenate([[0], word_ends])[np.searchsorted(starts, offsets)]


def encode_texts(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text in turn."""
    for ids, bounds in encode_column(column, path):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of its ids, their hash, and the hash of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load(model_path)
        decimal = np.array([str(i) for i in range(model.size)], object)
        for batch in batches:
            counts, ids_hash, decoded_hash = [], [], []
            for ids in encode_texts(batch.column("text"), model_path):
                counts.append(len(ids))
                listed = ",".join(decimal[ids].tolist())
                ids_hash.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded_hash.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_hash, pa.string()),
                    pa.array(decoded_hash, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """The rows with the ids of their texts as ``ids`` (which replaces a column of that name)."""
    from pyspark.sql import types as T

    added = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    kept = [f for f in docs.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for ids, bounds in encode_column(batch.column("text"), model_path):
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))
                )
                part = batch.slice(first, len(lists))
                first += len(lists)
                columns = [*(part.column(f.name) for f in kept), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "ids"])

    return docs.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, added]))


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """The rows with the text of their ``ids`` as ``text`` (which replaces a column of that name).

    Null ids give a null text.
    """
    from pyspark.sql import types as T

    added = T.StructField("text", T.StringType())
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load(model_path)
        for batch in batches:
            lists = batch.column("ids")
            texts = [
                model.decode(lists[k].values.to_numpy()) if lists[k].is_valid else None
                for k in range(len(lists))
            ]
            columns = [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "text"])

    return rows.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, added]))
