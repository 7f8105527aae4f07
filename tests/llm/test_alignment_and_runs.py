"""Periodic runs, token alignment and piece encoding against plain versions and the library."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.conftest import prose  # noqa: E402
from voltledger.llm import periodic_runs, piece_bpe, text_batch, token_alignment  # noqa: E402

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "B", "é", " ", "  ", "     ", "\n", "\t", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>",
          "中", "文", "😀", "the", "ing", "\x00", "\x85", "ﬁ", "123", "...", "==", "aaaa", "--------", "\r\n", "　", "̈"]


def random_texts(count: int, seed: int = 7) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(count)]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows_of(df) -> list:
    return [tuple(r) for r in df.collect()]


# -- 11: periodic runs ------------------------------------------------------------------------------


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, e = i - q, j
            if j > i and e - s >= max(6, 4 * q):
                if not any(all(w[k] == w[k - r] for k in range(s + r, e)) for r in range(1, q)):
                    out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_report(doc_id, text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(count: int) -> list[list[str]]:
    rnd = random.Random(5)
    out = []
    for _ in range(count):
        w = [rnd.choice("abcdefg"[: rnd.choice([1, 2, 3, 5])]) for _ in range(rnd.randrange(50))]
        base = [rnd.choice("abcx") for _ in range(rnd.randrange(1, 14))]
        at = rnd.randrange(20)
        w = w[:at] + (base * 10)[: rnd.randrange(10 * len(base) + 1)] + w[at:]
        w += [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))] * rnd.randrange(7)
        out.append(w)
    return out


def test_runs_equal_a_plain_search():
    texts = periodic_texts(1500)
    words = text_batch.words(pa.array([" ".join(w) for w in texts]))
    found = periodic_runs.find_runs(words.hashes(), words.bounds)
    got = [[] for _ in texts]
    for r, *run in zip(*(x.tolist() for x in (found.row, found.start, found.length, found.period))):
        got[r].append(tuple(run))
    assert got == [plain_runs(w) for w in texts]
    assert len(found.row) > 1000


def test_one_word_many_times_is_one_run_in_little_time():
    words = text_batch.words(pa.array(["a " * 300_000]))
    found = periodic_runs.find_runs(words.hashes(), words.bounds)
    assert (found.length.tolist(), found.period.tolist()) == ([300_000], [1])


def test_run_report(spark, docs, no_docs):
    got = rows_of(periodic_runs.report(docs))
    wanted = [plain_report(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(got) == Counter(wanted)
    many = [(i, " ".join(w)) for i, w in enumerate(periodic_texts(200))]
    rewritten = [(i, prose(i, 40)) for i in range(1000, 1150)]
    rows = spark.createDataFrame(many + rewritten, "doc_id long, text string")
    got = rows_of(periodic_runs.report(rows))
    assert sorted(got) == [plain_report(*r) for r in many + rewritten]
    assert sum(r[1] > 0 for r in got[-150:]) > 3
    assert periodic_runs.report(no_docs).count() == 0


def test_runs_and_collapsed_texts(spark, docs, no_docs):
    rows = spark.createDataFrame([(1, "x a b a b a b a b y", 5), (1, " plain  text ", 6), (2, None, 7)],
                                 "doc_id long, text string, start long")
    assert rows_of(periodic_runs.runs(rows)) == [(1, 1, 8, 2)]
    assert rows_of(periodic_runs.collapse(rows)) == [(1, "x a b y", 5), (1, " plain  text ", 6), (2, None, 7)]
    assert periodic_runs.collapse(docs).columns == docs.columns
    assert periodic_runs.runs(no_docs).count() == periodic_runs.collapse(no_docs).count() == 0


# -- 12: alignment ----------------------------------------------------------------------------------


def plain_alignment(rows):
    """doc_id, counts, hash and links of each row by comparing all spans."""
    a_lib = tokenizers.Tokenizer.from_file(BYTE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = {c: bytes([b]) for b, c in enumerate(token_alignment._byte_letters())}

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(ids, raw):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(raw(i))))
            at += len(raw(i))
        return out

    found = []
    for doc_id, text in rows:
        a = b = []
        if text:
            a = spans(a_lib.encode(" " + text, add_special_tokens=False).ids,
                      lambda i: b"".join(letters[c] for c in a_lib.id_to_token(i)))
            b = spans(b_lib.encode(text), b_bytes)
            whole = (" " + text).encode()
            a_text = b"".join(b"".join(letters[c] for c in a_lib.id_to_token(i)) for i, _, _ in a)
            if a_text != whole or b"".join(b_bytes(i) for i, _, _ in b) != whole:
                a = b = []
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, low = [], 0
        for e in ends:
            parts.append("|".join(",".join(str(i) for i, s, f in side if low < f <= e) for side in (a, b)))
            low = e
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        found.append((doc_id, len(a), len(b), len(ends), links, sha(";".join(parts)) if parts else ""))
    counts = Counter(link for row in found for link in row[4])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return Counter(
        (d, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h)
        for d, na, nb, ng, ls, h in found
    ), counts


@pytest.mark.parametrize("block", [token_alignment.BLOCK_BYTES, 200])
def test_alignment(spark, docs, block, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "PART_BYTES", 100)
    rows = [(i, t) for i, t in enumerate(random_texts(150) + [prose(s, 30) for s in range(20)])]
    rows += [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in docs.select("doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted, counts = plain_alignment(rows)
    assert Counter(rows_of(token_alignment.report(frame, BYTE, PIECE))) == wanted
    pairs = {(a, b): n for a, b, n in rows_of(token_alignment.pair_counts(frame, BYTE, PIECE))}
    assert pairs == counts
    hashes = Counter((d, sha(g) if g else "") for d, g in rows_of(token_alignment.groups(frame, BYTE, PIECE)))
    assert hashes == Counter({k: sum(n for r, n in wanted.items() if (r[0], r[-1]) == k) for k in hashes})


def test_alignment_of_an_empty_table_and_of_clashing_columns(docs, no_docs):
    assert token_alignment.report(no_docs, BYTE, PIECE).count() == 0
    clash = docs.withColumnRenamed("key", "block").withColumnRenamed("words", "pairs").where("doc_id < 5")
    assert token_alignment.report(clash, BYTE, PIECE).count() == clash.count()


def test_numbers_as_bytes():
    rnd = random.Random(1)
    for most in (1, 100, 200, 20_000, 1 << 40):
        values = np.array([rnd.randrange(most) for _ in range(300)], np.int64)
        assert token_alignment.unpack(token_alignment.pack(values)).tolist() == values.tolist()
    assert len(token_alignment.unpack(token_alignment.pack(np.empty(0, np.int64)))) == 0


# -- 13: pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_piece_ids_are_those_of_the_library(library):
    rnd = random.Random(2)
    letters = "etaoinshrdlu"
    texts = random_texts(3000) + [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x3100)]
    texts += ["".join(rnd.choice(letters + "  ") for _ in range(300)) for _ in range(500)]
    texts += ["x" * 9000, "=-" * 3000, " " * 40_000, "a" + " " * 33 + "b", "".join(rnd.choice(letters) for _ in range(9000)),
              "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), "", None]
    got = [ids.tolist() for ids in piece_bpe.encode_texts(pa.array(texts), PIECE)]
    wanted = library.encode([t or "" for t in texts], num_threads=1)
    assert got == wanted
    model, _ = piece_bpe.load(PIECE)
    assert [model.decode(np.array(ids, np.int64)) for ids in wanted] == [library.decode(ids) for ids in wanted]


def test_any_ids_decode_as_in_the_library(library):
    model, _ = piece_bpe.load(PIECE)
    rnd = random.Random(3)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32_000), 28705, 259, rnd.randrange(3)])
               for _ in range(rnd.randrange(8))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_a_merge_that_makes_a_better_pair_stops_the_round():
    """One merge after the other, best rank first and leftmost, gives the same."""
    model, _ = piece_bpe.load(PIECE)
    exact = {int(k): (int(r), int(m)) for k, r, m in zip(model.keys, model.ranks, model.made)}
    ids = dict(zip(model.char.tolist(), model.char_symbol.tolist()))
    rnd = random.Random(4)
    for _ in range(300):
        word = "".join(rnd.choice("aeionrst") for _ in range(rnd.randrange(1, 40)))
        left = [ids[ord(c)] for c in word]
        while True:
            ranked = [(exact[k][0], i, exact[k][1]) for i, (a, b) in enumerate(zip(left, left[1:]))
                      if (k := a * int(model.width) + b) in exact]
            if not ranked:
                break
            _, i, made = min(ranked)
            left[i : i + 2] = [made]
        symbols = np.array([ids[ord(c)] for c in word], np.int64)
        assert model.merge(symbols, np.zeros(len(word), np.int64))[0].tolist() == left


def test_piece_queries(spark, docs, no_docs, library):
    wanted = Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "")
        wanted[(row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert Counter(rows_of(piece_bpe.encode_decode(docs, PIECE))) == wanted
    assert piece_bpe.encode_decode(no_docs, PIECE).count() == 0
    encoded = piece_bpe.encode(docs, PIECE)
    assert encoded.columns == [*docs.columns, "ids"]
    back = piece_bpe.decode(encoded.withColumnRenamed("text", "was"), PIECE)
    assert all(r.text == (r.was or "").replace("▁", " ") for r in back.collect())
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert rows_of(piece_bpe.decode(nothing, PIECE)) == [(1, None, None)]
