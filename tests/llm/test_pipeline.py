"""The rows of the pipeline against a plain version of its stages, given the fitted classifier's scores,
the spans of random strings (a matter of the whole table) and how often the mix takes a document."""

from __future__ import annotations

import os
import re
from collections import Counter
from pathlib import Path

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from tests.llm.test_joins import groups  # noqa: E402
from voltledger.llm import mixing, quality, queries, secrets  # noqa: E402
from voltledger.sources.staging import Staging  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the benchmark tables")
WORD = re.compile("[^\x20\x09-\x0D]+")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def one_of_each_group(texts: dict) -> set:
    """The documents that stay: the smallest id of each component of links of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, links = sorted(sets), []
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                links.append((i, j))
    root, _ = groups(ids, links)
    return {i for i in ids if root[i] == i}


def pattern_spans(text: str) -> list[tuple[int, int]]:
    spans = [m.span() for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_a_plain_version(spark):
    documents = queries.table(spark, SF_DIR, "documents")
    scores = quality.classify(documents, queries.table(spark, SF_DIR, "labels"))
    good = {r.doc_id for r in scores.where("predicted = 1").select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert 0 < len(good) < len(texts) == documents.count()

    alone = one_of_each_group({i: texts[i] for i in good})
    assert len(alone) < len(good)

    rows = documents.where(documents.doc_id.isin(sorted(alone)))
    random = {r.doc_id: re.findall(r"random:(\d+):(\d+)", r.spans) for r in secrets.report(rows).collect()}
    clean = {}
    for i in alone:
        spans = pattern_spans(texts[i] or "") + [(int(a), int(b)) for a, b in random[i]]
        clean[i] = masked(texts[i], spans) if spans else texts[i]
    assert any(clean[i] != texts[i] for i in alone)

    staging = Staging(spark, "test-pipeline")
    safe = staging.write(secrets.redact(rows))
    assert {r.doc_id: r.text for r in safe.collect()} == clean
    taken = {r.doc_id: (r.taken, r.size, r.target, r.source_size) for r in mixing.report(safe).collect()}
    copies = {i: n // size for i, (n, size, _, _) in taken.items() if size}
    assert all(0 <= n <= 2 and n * taken[i][1] == taken[i][0] for i, n in copies.items())
    assert {i: taken[i][1] for i in taken} == {i: len(WORD.findall(t or "")) for i, t in clean.items()}

    library = tokenizers.Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    wanted = Counter()
    for i, n in copies.items():
        wanted[i, tuple(library.encode(clean[i] or "", add_special_tokens=False).ids)] += n
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert {k: n for k, n in got.items() if k[0] in copies} == {k: n for k, n in wanted.items() if n}
    assert all(taken[k[0]][1] == 0 for k in got if k[0] not in copies)
    staging.drop()
