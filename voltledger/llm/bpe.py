"""Byte-pair encoding of words by speculation, and decoding (operator 3).

A word's encoding is proposed by greedy longest match. A sequence of tokens is what the merges give
exactly when every two neighbours stay apart if merged alone, so each adjacent pair is tested, all
pairs at once, by walking the last pieces of the left token and the first pieces of the right one back
through the merges. Words with a pair that fails, or with a token that no merging reaches, are merged
exactly. Each distinct word of a batch is done once.

Defined cases: null and empty texts have no ids and decode to the empty text; the strings of special
tokens are their ids wherever they occur, as in the library; other columns are ignored; one row comes
out per row that goes in, ties and repeated rows included.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voltledger.llm.text_batch import Memo, distinct, hash_spans, ranges, slices, words

MEMO_WORDS = 500_000
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = np.int64(1) << 40
_LATIN = re.compile("[\x00-\u024f]*")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others numbered from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file whose words end in a suffix.

    Symbols are 0-255 for a byte and 256-511 for the last byte of a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile(
            "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)"
        )
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(size, "", object)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text

        letters = {c: b for b, c in enumerate(_byte_letters())}
        self.letters = letters
        self.symbol_id = np.full(512, -1, np.int64)
        for c, b in letters.items():
            self.symbol_id[b] = vocab.get(c, -1)
            self.symbol_id[b + 256] = vocab.get(c + suffix, -1)

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = size
        pairs = left * size + right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int64)
        self.exact = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left, right, made))}
        # How a token was made, and when; single symbols were there before all merges.
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        for rank in range(len(merges) - 1, -1, -1):
            self.left[made[rank]], self.right[made[rank]] = left[rank], right[rank]
            self.born[made[rank]] = rank
        self._build_trie(vocab, letters, suffix)
        self._find_reachable(vocab, made)

    def _build_trie(self, vocab, letters, suffix) -> None:
        edges, accept = {}, [-1]
        for text, i in vocab.items():
            last = text.endswith(suffix) and len(text) > len(suffix)
            symbols = [letters[c] for c in (text[: -len(suffix)] if last else text)]
            if last:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                nxt = edges.get(node * 512 + s)
                if nxt is None:
                    nxt = edges[node * 512 + s] = len(accept)
                    accept.append(-1)
                node = nxt
            accept[node] = i
        self.accept = np.array(accept, np.int64)
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges = keys[order]
        self.targets = np.fromiter(edges.values(), np.int64, len(edges))[order]

    def _find_reachable(self, vocab, made) -> None:
        """Tokens that merging their own symbols yields."""
        composed = np.unique(made)
        apart = self.stays_apart(self.left[composed], self.right[composed], self.born[composed])
        good = np.ones(self.width, bool)
        good[composed] = apart
        for token in composed[np.argsort(self.born[composed])]:
            good[token] &= good[self.left[token]] and good[self.right[token]]
        self.reachable = good

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def stays_apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None):
        """Whether merging never crosses from token a to token b (before the merge ``until``).

        The piece of a that ends at the border and the piece of b that begins there are taken back
        merge by merge, the younger first. At each step they exist side by side until the older of
        their own next merges, and would be joined if their pair comes earlier; at equal rank the
        left place merges first.
        """
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if until is None else until.copy()
        x_next, y_next = limit.copy(), limit.copy()
        apart = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            u, v = x[live], y[live]
            rank = self._rank(u, v)
            joined = (rank < x_next[live]) & (
                (rank < y_next[live]) | ((rank == y_next[live]) & (rank < NEVER))
            )
            if until is not None:
                joined &= rank < limit[live]
            apart[live[joined]] = False
            live = live[~joined & ((self.born[u] >= 0) | (self.born[v] >= 0))]
            u, v = x[live], y[live]
            back_left = self.born[u] > self.born[v]
            # A rank on both sides is one merge at two places, taken back on the right first.
            l, r = live[back_left], live[~back_left]
            x_next[l], x[l] = self.born[x[l]], self.right[x[l]]
            y_next[r], y[r] = self.born[y[r]], self.left[y[r]]
        return apart

    def merge(self, symbols: np.ndarray) -> list[int]:
        """The exact encoding of one word, by rank and from left to right."""
        ids = self.symbol_id[symbols].tolist()
        ids = [i for i in ids if i >= 0]
        exact, none = self.exact, (NEVER, -1)
        while len(ids) > 1:
            best = min(zip(ids, ids[1:]), key=lambda p: exact.get(p, none)[0])
            rank, made = exact.get(best, none)
            if made < 0:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                    out.append(int(made))
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Greedy longest match of all words at once: tokens with the word of each, in order."""
        at, owner = starts.copy(), np.arange(len(starts))
        word_of, token_of, step_of, step = [], [], [], 0
        stuck = np.zeros(len(starts), bool)
        while len(owner):
            node = np.zeros(len(owner), np.int64)
            token = np.full(len(owner), -1, np.int64)
            reach, cursor, lane = at.copy(), at.copy(), np.arange(len(owner))
            while len(lane):
                key = node[lane] * 512 + symbols[cursor[lane]]
                edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[edge] == key
                lane, edge = lane[hit], edge[hit]
                node[lane] = self.targets[edge]
                cursor[lane] += 1
                whole = self.accept[node[lane]] >= 0
                token[lane[whole]] = self.accept[node[lane[whole]]]
                reach[lane[whole]] = cursor[lane[whole]]
                lane = lane[cursor[lane] < ends[owner[lane]]]
            stuck[owner[token < 0]] = True
            word_of.append(owner[token >= 0])
            token_of.append(token[token >= 0])
            step_of.append(np.full(int((token >= 0).sum()), step))
            more = (token >= 0) & (reach < ends[owner])
            at, owner, step = reach[more], owner[more], step + 1
        word = np.concatenate(word_of)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate(token_of)[order], stuck

    def encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in a row, the number of each word's, and how many were merged exactly."""
        raw = [w.encode() for w in found]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        word, token, failed = self.propose(symbols, ends - lengths, ends)
        failed[word[~self.reachable[token]]] = True
        inner = np.flatnonzero(word[:-1] == word[1:])
        pairs, place = np.unique(token[inner] * self.width + token[inner + 1], return_inverse=True)
        apart = self.stays_apart(pairs // self.width, pairs % self.width)
        failed[word[inner[~apart[place]]]] = True
        counts = np.bincount(word, minlength=len(raw))
        again = np.flatnonzero(failed)
        if len(again):
            merged = [self.merge(symbols[ends[i] - lengths[i] : ends[i]]) for i in again]
            kept = ~failed[word]
            extra = np.fromiter((len(m) for m in merged), np.int64, len(merged))
            counts[again] = extra
            word = np.concatenate([word[kept], np.repeat(again, extra)])
            token = np.concatenate([token[kept], np.array([t for m in merged for t in m], np.int64)])
            token = token[np.argsort(word, kind="stable")]
        return token, counts, len(again)

    def split(self, piece: str) -> list[str | int]:
        """The words of a stretch without plain white space; special tokens as their ids."""
        out, at = [], 0
        for special in self.special_pattern.finditer(piece):
            out += self._plain(piece[at : special.start()])
            out.append(self.special[special[0]])
            at = special.end()
        return out + self._plain(piece[at:])

    def _plain(self, piece: str) -> list[str]:
        """Letters beyond Latin are told apart by the library, whose character tables are its own."""
        if not piece:
            return []
        piece = self.normalizer.normalize_str(piece)
        if _LATIN.fullmatch(piece):
            return self.pattern.findall(piece)
        found = self.pre_tokenizer.pre_tokenize_str(piece)
        return [bytes(self.letters[c] for c in word).decode() for word, _ in found]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and the number of each."""
        parts = [self.split(p) for p in pieces]
        number: dict[str | int, int] = {}
        use = [number.setdefault(w, len(number)) for part in parts for w in part]
        found = [w for w in number if isinstance(w, str)]
        tokens, counts = np.empty(0, np.int64), np.zeros(0, np.int64)
        if found:
            tokens, counts, _ = self.encode_words(found)
        # Distinct words and special ids in the order of their numbers.
        text = np.fromiter((isinstance(w, str) for w in number), bool, len(number))
        length = np.ones(len(number), np.int64)
        length[text] = counts
        flat = np.empty(int(length.sum()), np.int64)
        is_text = np.repeat(text, length)
        flat[is_text] = tokens
        flat[~is_text] = [w for w in number if not isinstance(w, str)]
        begin = np.cumsum(length) - length
        use = np.array(use, np.int64)
        per_piece = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), per_piece)
        lengths = np.bincount(owner, weights=length[use], minlength=len(parts)).astype(np.int64)
        return flat[ranges(begin[use], length[use])], lengths

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids in a tokenizer without decoder: tokens joined by spaces."""
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str) -> tuple[WordBpe, Memo]:
    return WordBpe(path), Memo(np.uint32, MEMO_WORDS)


def encode_column(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text in turn."""
    model, memo = load(path)
    for first, last in slices(column):
        found = words(column.slice(first, last - first))
        keys, places, codes = distinct(found.hashes())
        rows = memo.rows_of(
            keys, lambda missing: model.encode_pieces([found.text(w) for w in places[missing]])
        )
        ids, ends = memo.gather(rows[codes])
        ends = np.concatenate([[0], ends])[found.bounds]
        for a, b in zip(ends[:-1], ends[1:]):
            yield ids[a:b]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number of its ids, their hash, and the hash of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load(tokenizer_path)
        for batch in batches:
            counts, ids_hash, decoded_hash = [], [], []
            for ids in encode_column(batch.column("text"), tokenizer_path):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
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


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows without ``text``, with the ids of their texts, their number and the hash of the text
    they decode to as columns ids, n_tokens and decoded_sha256 (which replace columns of that name)."""
    from pyspark.sql import types as T

    added = [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    taken = {"text", *(f.name for f in added)}
    kept = [f for f in docs.schema.fields if f.name not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load(tokenizer_path)
        names = [*(f.name for f in kept), *(f.name for f in added)]
        for batch in batches:
            texts = batch.column("text")
            ids = encode_column(texts, tokenizer_path)
            # A few rows at a time: ids take more room than their text.
            for first, last in slices(texts):
                part = [next(ids) for _ in range(last - first)]
                lengths = np.array([len(p) for p in part], np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                decoded = [hashlib.sha256(model.decode(p).encode()).hexdigest() for p in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(f.name).slice(first, last - first) for f in kept),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(np.concatenate(part).astype(np.int32))
                        ),
                        pa.array(lengths),
                        pa.array(decoded, pa.string()),
                    ],
                    names=names,
                )

    columns = [*(f.name for f in kept), "text"]
    return docs.select(*columns).mapInArrow(run, T.StructType([*kept, *added]))
