"""Each operator on edge cases against a plain version of the same contract."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.conftest import prose  # noqa: E402
from voltledger.llm import bpe, licenses, mixing, secrets, syncmers, text_batch, token_output  # noqa: E402

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PIECES = ["a", "B", "é", "'s", "'", "\n", " ", "  ", "12", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "中", "。",
          "　", "̈", "!", "#", "\t", "\r\n", "_", "ﬁ", "²", "😀", "the", "ing", "\x1c", "\x85", "՘", "<|"]


def random_texts(count: int) -> list[str]:
    rnd = random.Random(7)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(count)]


def rows_of(df) -> list:
    return [tuple(r) for r in df.collect()]


# -- shared arrays ----------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = [*random_texts(300), None, "", "a b c d e f g a b c d e"]
    found = text_batch.words(pa.array(texts))
    for i, text in enumerate(texts):
        own = range(found.bounds[i], found.bounds[i + 1])
        assert [found.text(w) for w in own] == re.findall("[^\x20\x09-\x0D]+", text or "")
    sets = list(text_batch.shingle_sets(pa.array(texts)))
    words = texts[-1].split()
    assert len(sets[-1]) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert len(sets[-2]) == len(sets[-3]) == 0


def test_long_words_differ():
    texts = pa.array(["x" * 5000, "x" * 4999 + "y", "x" * 5000])
    one, two, three = text_batch.words(texts).hashes()
    assert one == three != two


# -- 1 and 3: tokens --------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path):
    texts = random_texts(3000) + [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x3100)]
    wanted = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    if path == WORD:
        got = [ids.tolist() for ids in bpe.encode_column(pa.array(texts), path)]
    else:
        parts = token_output.encode_column(pa.array(texts), path)
        got = [ids[a:b].tolist() for ids, ends in parts for a, b in zip(ends[:-1], ends[1:])]
    assert got == wanted


def test_a_small_memo_changes_nothing(monkeypatch):
    column = pa.array(random_texts(400))
    wanted = [ids.tolist() for ids in bpe.encode_column(column, WORD)]
    model, _ = bpe.load(WORD)
    monkeypatch.setattr(bpe, "load", lambda _: (model, text_batch.Memo(np.uint32, 10)))
    assert [ids.tolist() for ids in bpe.encode_column(column, WORD)] == wanted


def test_speculation_is_verified():
    """Some words must fail the pair test, and merging the rest exactly gives the same."""
    model, _ = bpe.load(WORD)
    words = sorted({w for s in range(40) for t in prose(s, 200).split() for w in model.split(t)})
    tokens, counts, merged = model.encode_words(words)
    assert 0 < merged < len(words)
    ends = np.cumsum(counts)
    for word, end, count in zip(words, ends, counts):
        symbols = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
        symbols[-1] += 256
        assert tokens[end - count : end].tolist() == model.merge(symbols)


def test_encode_decode(docs, no_docs):
    library = tokenizers.Tokenizer.from_file(WORD)
    got = Counter(rows_of(bpe.encode_decode(docs, WORD)))
    wanted = Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted[(row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert got == wanted
    assert bpe.encode_decode(no_docs, WORD).count() == 0
    full = bpe.encoded(docs, WORD)
    assert full.count() == docs.count() and "text" not in full.columns and "key" in full.columns


def test_token_shards(spark, docs, no_docs, tmp_path):
    library = tokenizers.Tokenizer.from_file(BYTE)
    folder = f"file://{tmp_path}/shards"
    shards = token_output.write_token_shards(docs, BYTE, folder)
    got = sorted(rows_of(token_output.read_token_shards(shards)), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    start = 0
    for row, found in zip(rows, got, strict=True):
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert found[:4] == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = next(s for s in map(token_output.ShardReader, (r.path for r in shards.collect())) if len(s.find(6)))
    assert shard.find(6)[0][-1] == 0 and shard.find(10**9) == []
    assert token_output.token_output(no_docs, BYTE, folder=f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("texts", [["one two three"] * 8, [prose(i, 40) for i in range(3)],
                                   [prose(i, 200) for i in range(60)], ["", None]])
def test_small_tables_have_a_dictionary_too(spark, tmp_path, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = len(token_output.train_dictionary(rows, BYTE, 0, 2))
    library = tokenizers.Tokenizer.from_file(BYTE)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert (size > 0) == (2 * sum(len(i) - 1 for i in ids) >= token_output.LEAST_SAMPLE)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.token_output(rows, BYTE).collect()}
    assert got == {n: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for n, i in enumerate(ids)}


def test_dictionary_is_checked(spark, docs, tmp_path):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(prose(5, 90)), "id").alias("text"))
    shards = token_output.write_token_shards(many, BYTE, f"file://{tmp_path}")
    path = shards.first().path
    reader = token_output.ShardReader(path)
    assert reader.dictionary_hash != hashlib.sha256(b"").hexdigest()
    (tmp_path / f"{reader.dictionary_hash}.dict").write_bytes(b"other")
    with pytest.raises(ValueError, match="damaged"):
        token_output.ShardReader(path)


# -- 2: secrets -------------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_pattern_spans(docs, no_docs):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(docs).collect())
    wanted = Counter()
    for row in docs.collect():
        spans = plain_spans(row.text or "")
        kinds = Counter(k for _, k, _ in spans)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted[(row.doc_id, kinds[0], kinds[1], kinds[2], hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert got == wanted
    assert secrets.report(no_docs).count() == 0


def test_random_strings_are_told_from_names(spark):
    rnd = random.Random(3)
    signs = secrets.ALPHABETS["base64"]
    keys = ["".join(rnd.choice(signs[:62]) for _ in range(40)) + "a1B" for _ in range(300)]
    names = [f"get{w.title()}And{prose(i, 1).title()}V{i % 10}{'Manager' * 3}Factory" for i, w in enumerate(prose(9, 300).split())]
    rows = [(i, f"see 😀 {s} here", s) for i, s in enumerate([*keys, *names])]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string")
    found = {r.doc_id: r for r in secrets.report(df).collect()}
    hits = [found[i].n_random for i in range(300)]
    false = [found[i].n_random for i in range(300, 600)]
    assert sum(hits) > 270 and sum(false) < 30
    one = next(i for i in range(300) if found[i].n_random)
    assert found[one].spans == f"random:6:{6 + len(keys[one])}"


def test_keys_of_one_case_and_without_digits_are_candidates(spark):
    rnd = random.Random(7)
    lower = "abcdefghijklmnopqrstuvwxyz"
    kinds = [(lower + "234567", 52), (lower + "0123456789", 32), (lower + lower.upper(), 20), (lower, 40)]
    keys = [(k, "".join(rnd.choice(signs) for _ in range(n))) for k, (signs, n) in enumerate(kinds) for _ in range(200)]
    names = [("_" if i % 2 else "").join(w if j % 2 else w.title() for j, w in enumerate(prose(i, 6).split()))
             for i in range(300)]
    names += [prose(i, 12).replace(" ", "-/_"[i % 3]) for i in range(300)]
    names += [prose(i, 9).replace(" ", "") for i in range(300)]
    names = [n for n in names if len(n) >= 20]
    rows = [(i, f"see {s} here") for i, s in enumerate([*(s for _, s in keys), *names])]
    found = {r.doc_id: r.n_random for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(len(kinds)):
        hits = [found[i] for i, (k, _) in enumerate(keys) if k == kind]
        assert sum(hits) > 0.4 * len(hits), (kind, sum(hits))
    assert sum(found[i] for i in range(len(keys), len(rows))) < 0.05 * len(names)


def test_words_alone_are_no_keys(spark):
    rows = [(i, f"see {prose(i, 9).replace(' ', '')[:20 + i % 20]} here") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.select(F.explode(secrets._candidates(F.col("text")))).count() > 300
    assert secrets.report(df).agg(F.sum("n_random")).first()[0] == 0


def test_p_values_are_even_for_random_strings(spark):
    rnd = random.Random(4)
    rows = [("".join(rnd.choice("0123456789abcdef") for _ in range(40)),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string").select(secrets.p_value(F.col("s"), F.lit(secrets.ALPHABETS["hex"])).alias("p"))
    p = np.array([r.p for r in df.collect()])
    assert abs(p.mean() - 0.5) < 0.05 and abs((p > 0.5).mean() - 0.5) < 0.06


def test_redaction(docs):
    after = {r.doc_id: r for r in secrets.redact(docs).collect() if r.doc_id is not None}
    assert secrets.redact(docs).columns == docs.columns
    for row in docs.collect():
        if row.doc_id is None:
            continue
        text, at, out = row.text, 0, ""
        spans = plain_spans(text or "")
        if not spans:
            assert after[row.doc_id].text == text
            continue
        for start, _, end in spans:
            if start >= at:
                out += text[at:start] + secrets.MASK
            at = max(at, end)
        out += text[at:]
        assert after[row.doc_id].text == out and after[row.doc_id].n_chars == len(out)


# -- 4: mixing --------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        goal = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        new = {s for s in names if s not in full and goal[s] > 2 * sizes[s]}
        if not new:
            return goal
        full |= new


def check_mix(df, near: float | None):
    words = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    source = {}
    for row in df.collect():
        sizes[row.source] += words(row.text)
        source[row.doc_id] = row.source
    goal = plain_targets(sizes)
    rows = mixing.report(df).collect()
    assert len(rows) == df.count()
    for row in rows:
        name = source[row.doc_id]
        assert row.source_size == sizes[name] and row.target == pytest.approx(goal[name], abs=1e-6)
        assert 0 <= row.taken <= 2 * row.size
        taken[name] += row.taken
    if near:
        for name in sizes:
            assert abs(taken[name] - goal[name]) <= near * max(goal[name], 1)
    return rows


def test_mix_edge_cases(docs, no_docs):
    check_mix(docs, None)
    assert mixing.report(no_docs).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.report(docs).collect())


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    """One source holds a third of all rows, many of them of one size."""
    rnd = random.Random(2)
    rows = [(i, prose(i, 50 if i % 3 == 0 else rnd.randrange(1, 400)), "a" if i % 3 == 0 else f"b{i % 5}")
            for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = check_mix(df, 0.01)
    again = mixing.report(df.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


# -- 7: syncmers ------------------------------------------------------------------------------------


def test_fingerprints(docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    found = syncmers.fingerprints(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    order = sorted((i for i, _ in rows if i is not None and i != 6), reverse=True)
    texts = dict(rows)
    for one, following in zip(order, order[1:]):
        if 6 in range(following, one):
            continue  # the repeated row may come between
        text = texts[one]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[following][:cut]
        row = by_id[one]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert by_id[7].fingerprint == by_id[8].fingerprint != by_id[9].fingerprint
    assert by_id[0].fingerprint == by_id[1].fingerprint == by_id[3].fingerprint == ""
    assert syncmers.fingerprints(no_docs).count() == 0


def test_anchors_do_not_depend_on_their_surroundings(spark):
    passage = prose(11, 80)
    texts = [passage, prose(12, 33) + " " + passage + " " + prose(13, 9)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    alone, inside = (dict(zip(r.a_at, r.a)) for r in syncmers.with_anchors(df, "t", "a").collect())
    own = {at: h for at, h in alone.items() if 0 <= at}
    assert own and all(inside[at + 33] == h for at, h in own.items())
    dense = [at for at in sorted(alone)]
    assert max(b - a for a, b in zip(dense, dense[1:])) <= syncmers.K - syncmers.S




def plain_marks(text: str) -> list[tuple[int, int]]:
    """(32 bits of the hash, distance from the anchor before) of each anchor, word by word."""
    def chained(*numbers):
        seed = 42
        for n in numbers:
            seed = xxhash.xxh64_intdigest((n % 2**64).to_bytes(8, "little"), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    units = []
    for word in re.split(r"[\x20\x09-\x0D]+", text):
        for piece in re.findall(f"[{syncmers.UNSPACED}]|[^{syncmers.UNSPACED}]+", word):
            units += [piece] if len(piece) <= syncmers.LONG else list(piece)
    if not units:
        return []
    k, s = syncmers.K, syncmers.S
    hashes = [syncmers.BEFORE] * (k - 1) + [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    marks, before = [], None
    for i in range(len(hashes) - k + 1):
        inner = [chained(*hashes[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            marks.append((chained(*hashes[i:i + k]) % 2**32, 0 if before is None else i - before))
            before = i
    return marks


def plain_likeness(one: list, other: list) -> float:
    union = sum(max(1, gap) for _, gap in {*one, *other})
    return sum(max(1, gap) for _, gap in {*one} & {*other}) / union if union else 1.0


def test_fingerprints_equal_a_plain_version(spark):
    rnd = random.Random(77)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(900))
    texts = [
        "", None, " \t\n", "one", "one two three", "a " * 500, prose(1, 400), prose(2, 400), han, han[:700] + "x y",
        "mixed " + han[:30] + " and words " + han[30:50], "y" * 40, "y" * 41, "z" * 3000, prose(5, 20) + "q" * 100,
        "".join(rnd.choices("abcdef0123456789", k=2000)), "😀 é\u00a0b\x0bc", "สวัสดีครับ ทุกคน", "x" * 39 + han[:2] + "x" * 45,
        *(prose(i, rnd.randrange(60)) for i in range(100, 130)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(syncmers.fingerprints(df).collect(), key=lambda r: -r.doc_id)
    assert len(rows) == len(texts)
    for at, row in enumerate(rows):
        text, following = (texts[rows[i % len(rows)].doc_id] or "" for i in (at, at + 1))
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        own, changed, other = map(plain_marks, (text, edited, following))
        assert row.fingerprint == "".join(f"{h:08X}{gap:X}" for h, gap in own)
        assert row.edited_fingerprint == "".join(f"{h:08X}{gap:X}" for h, gap in changed)
        assert row.near_edited == pytest.approx(plain_likeness(own, changed), abs=1e-12)
        assert row.near_next == pytest.approx(plain_likeness(own, other), abs=1e-12)
        if row.doc_id in (6, 7, 8, 13, 15):
            assert row.near_edited > 0.4


# -- 8: licenses ------------------------------------------------------------------------------------


def test_licenses(spark, docs, no_docs):
    found = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license, r.containment) for r in found] == [(14, "MIT", 1.0)]
    assert (found[0].first_char, found[0].end_char) == (0, 30)
    assert licenses.scan(no_docs).count() == 0
    rows, at = [], 0
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for before in (0, 3, 50):
                words = notice.upper().split()
                if len(words) > 25:
                    words[-1] = "changed"
                rows.append((at, f"{prose(at, before)} é\n{' '.join(words)} {prose(at + 1, 30)}", name))
                at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(name in got.get(i, ()) for i, _, name in rows)


GNU_HEADER = """ * This {what} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {name} as published by
 * the Free Software Foundation, either version {version} of the License, or
 * (at your option) any later version.
 *
 * This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
 * You should have received a copy of the GNU General Public License and of the
 * GNU {name} along with it.
"""
BSD_HEAD = """Copyright (c) 1999, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS"
BSD_NAMES = """Neither the name of Big Company Inc. nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.
"""
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so"""


def test_license_texts_get_their_own_name(spark):
    def gnu(name, version):
        return GNU_HEADER.format(what="library", name=name, version=version)

    texts = [
        ("AGPL-3.0", gnu("Affero General Public License", 3)),
        ("LGPL-3.0", gnu("Lesser General Public License", 3)),
        ("LGPL-2.1", gnu("Lesser General Public License", 2.1)),
        ("GPL-3.0", gnu("General Public License", 3)),
        ("GPL-2.0", gnu("General Public License", 2)),
        ("GPL-2.0 LGPL-3.0", gnu("General Public License", 2) + gnu("Lesser General Public License", 3)),
        ("", gnu("General Public License", 1)),
        ("", "This work is licensed under the GNU General Public License, version 1."),
        ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
        ("BSD-3-Clause", BSD_HEAD + "3. " + BSD_NAMES + BSD_TAIL),
        ("BSD-4-Clause", BSD_HEAD + "3. All advertising materials mentioning features or use of this software "
         "must display the following acknowledgement: This product includes software developed by the Lab.\n4. "
         + BSD_NAMES + BSD_TAIL),
        ("BSD", BSD_HEAD[:300]),
        ("MIT", MIT_TEXT + ", subject to the following conditions: The above copyright notice and this permission "
         "notice shall be included in all copies or substantial portions of the Software."),
        ("MIT-0", MIT_TEXT + ". THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
        ("CC0-1.0", "To the extent possible under law, A. Body has waived all copyright and related or "
         "neighboring rights to this work."),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the "
         "Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ]
    rows = [(i, f"{prose(i, 40)}\n{t}\n{prose(i + 1, 60)}") for i, (_, t) in enumerate(texts)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert [" ".join(sorted(got.get(i, []))) for i in range(len(texts))] == [name for name, _ in texts]


def test_license_table_is_an_argument(spark):
    docs = spark.createDataFrame([(1, "Use is bound by the House Rules of Volt Ledger, edition 7, as posted.")],
                                 "doc_id long, text string")
    notice = "bound by the House Rules of Volt Ledger, edition 7"
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs, {}).count() == 0
    for table in ({"House": [notice]}, spark.createDataFrame([("House", notice)], "license string, notice string")):
        assert [(r.license, r.containment) for r in licenses.scan(docs, table).collect()] == [("House", 1.0)]
    with pytest.raises(ValueError):
        licenses.scan(docs, {"House": ["House Rules"]})


def test_license_bands_are_dense_enough():
    assert min(licenses.collision_probability(n) for n in range(1, 200)) >= 1 - licenses.MISS


@pytest.mark.parametrize("mention,name", [
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("released under the Apache License, Version 2.0", "Apache-2.0"),
    ("distributed under the terms of the GPL v3", "GPL-3.0"),
    ("It is available under the MIT license.", "MIT"),
    ("is licensed under the GPLv2", "GPL-2.0"),
    ("under the GNU Lesser General Public License v2.1 or later", "LGPL-2.1"),
    ("under the GNU Affero General Public License v3.0", "AGPL-3.0"),
    ("under the 3-Clause BSD License", "BSD-3-Clause"),
    ("under the terms of the Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("it went under the general public eye", None),
    ("under the terms of the treaty", None),
])
def test_license_mentions(mention, name):
    texts = pa.array([f"{prose(3, 12)} {mention} {prose(4, 9)}", mention, None, ""])
    found = list(licenses.find_in(texts, licenses._table(licenses.TEMPLATES)))
    assert [(row, license) for row, license, *_ in found] == ([] if name is None else [(0, name), (1, name)])


def test_license_bands_retrieve_what_all_pairs_of_windows_and_templates_find():
    """Every window against every template, without bands: the verified are the same."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    table, texts = {}, ["", None, "one two", "x " * 3000]
    for i, length in enumerate([5, 6, 8, 9, 13, 20, 40, 70, 130, 260] * 6):
        table[f"L{i}"] = [" ".join(rnd.choices(vocabulary, k=length))]
    notices = [notice[0].split() for notice in table.values()]
    for _ in range(400):
        words = rnd.choices(vocabulary, k=rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            notice = list(rnd.choice(notices))
            for _ in range(rnd.randrange(1 + len(notice) // 25)):
                notice[rnd.randrange(len(notice))] = "changed"
            if rnd.random() < 0.2:
                notice = notice[rnd.randrange(len(notice)):]
            words += notice + rnd.choices(vocabulary, k=rnd.randrange(90))
        texts.append(" ".join(words))
    pairs = licenses._table(table)
    templates, bands = licenses._templates(pairs)
    grams, bounds, *_ = licenses._shingles(pa.array(texts, pa.string()))
    met = licenses.retrieve(grams, bounds, bands).tolist()
    wanted, got, compared = set(), set(), 0
    for row in range(len(texts)):
        own = grams[bounds[row]:bounds[row + 1]]
        every = [
            (size, first, number)
            for number, (_, _, size, _) in enumerate(templates)
            for first in range(0, max(1, (-(-len(own) // size) - 1) * size), size)
        ]
        mine = [tuple(window[1:]) for window in met if window[0] == row]
        assert set(mine) <= set(every)
        compared += len(every)
        for windows, into in ((every, wanted), (mine, got)):
            for window in windows:
                into.update((row, window[1], held[0]) for held in licenses.verified(own, [window], templates))
    assert len(wanted) > 500 and got == wanted
    assert len(met) < compared / 100


@pytest.mark.parametrize("keys", [1, 5, 20, 100])
def test_few_keys_are_found_too(keys):
    """Recall of 0.9 over many tables, by the p-values of even draws in one stratum or in several."""
    rnd = random.Random(keys)
    found = total = 0
    for _ in range(2000 // keys):
        p_values = [rnd.random() for _ in range(keys)]
        for part in (p_values,) if rnd.random() < 0.5 else (p_values[::2], p_values[1::2]):
            steps = [0] * secrets.STEPS
            for p in part:
                steps[min(int(p * secrets.STEPS), secrets.STEPS - 1)] += 1
            cut = secrets._cut_off(False, steps)
            found += sum(p >= (2 if cut is None else cut) for p in part)
        total += keys
    assert found >= 0.9 * total


def test_ordinary_strings_without_keys_are_not_accepted():
    low = [40, 6, 2, *[1] * 10] + [0] * (secrets.STEPS - 13)
    assert secrets._cut_off(False, low) is None or secrets._cut_off(False, low) > 0.12
    identifiers = [50] + [3] * 30 + [0] * (secrets.STEPS - 31)
    cut = secrets._cut_off(False, identifiers)
    assert cut is None or sum(identifiers[int(cut * secrets.STEPS):]) == 0
    words = [400, 20, 10] + [1] * (secrets.STEPS - 3)
    assert secrets._cut_off(True, words) is None
    assert secrets._cut_off(True, [1] + [0] * (secrets.STEPS - 1)) is None


@pytest.mark.parametrize("keys", [1, 5, 20])
def test_random_keys_in_prose(spark, keys):
    rnd, letters = random.Random(keys), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted, rows = {}, []
    for i in range(60):
        planted[i] = "".join(rnd.choice(letters) for _ in range(rnd.randrange(24, 49))) if i < keys else ""
        rows.append((i, f"{prose(i, 30)} {planted[i]} {prose(i + 100, 30)}"))
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in got[i] for i in range(keys)) >= 0.9 * keys
    assert all(got[i] == "" for i in range(keys, 60))
