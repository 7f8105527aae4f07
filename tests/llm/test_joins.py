"""Near-duplicate joins, classifiers and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from voltledger.llm import embedding_dedup, features, ngram_join, quality, queries, toxicity
from voltledger.llm.components import components
from voltledger.sources.staging import Staging

SF_DIR = "/root/testdata/sf0.001"


def groups(ids, linked):
    """Smallest id reachable from each, and the number of direct links of each."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = dict.fromkeys(ids, 0)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, degree


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(3, 3)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in components(df, Staging(spark, "test")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 400))
    assert 3 not in got


def jaccard_links(texts: dict):
    sets = {}
    for i, text in texts.items():
        w = (text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    out = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                out.append((a, b))
    return out


def test_ngram_join_of_a_crowd(spark, monkeypatch):
    """One group of copies and one of near copies, cut into many chunks."""
    rnd = random.Random(1)
    base = prose(21, 90).split()
    texts = {}
    for i in range(260):
        if i % 3 == 0:
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(90)] = f"w{rnd.randrange(9)}"
            texts[i] = " ".join(words)
        elif i % 3 == 1:
            texts[i] = prose(22, 70)
        else:
            texts[i] = prose(i, rnd.randrange(0, 60))
    wanted, degree = groups(texts, jaccard_links(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for chunk in (256, 7):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        got = {r.doc_id: r for r in ngram_join.ngram_join(df).collect()}
        assert {i: r.component_id for i, r in got.items()} == wanted
        assert {i: r.n_links for i, r in got.items()} == degree
        assert {i for i, r in got.items() if r.kept} == set(wanted.values())
        assert all(r.class_id == 1 for i, r in got.items() if i % 3 == 1)


def test_ngram_join_edge_cases(docs, no_docs):
    rows = ngram_join.ngram_join(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_links == by_id[1].n_links == by_id[3].n_links == 0
    assert by_id[6].n_links == 4 and by_id[9].component_id == 6 and by_id[8].class_id == 6
    assert by_id[None].component_id is None and by_id[None].n_links == 0
    assert ngram_join.ngram_join(no_docs).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {7, 8, 9}.isdisjoint(ids) and {None, 0, 1, 2, 6} <= set(ids)


def test_one_doc_id_with_two_texts(spark):
    """Each text is judged by itself: the unique one of a repeated doc_id stays, the copy goes."""
    one, other, third = prose(71, 80), prose(72, 80), prose(73, 80)
    near = " ".join(["new", *third.split()[1:]])
    rows = [(1, other), (5, one), (5, other), (7, third), (7, near), (7, near), (8, near), (9, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(df).collect())
    stays = [k for k in kept if k[0] == 7]
    assert kept == sorted([(1, other), (5, one), *stays, (9, ""), (9, "")])
    assert len(stays) == 1 and stays[0][1] in (third, near)
    found = sorted((r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in ngram_join.ngram_join(df).collect())
    assert found[0] == (1, 1, 1, 1, True) and (5, 5, 0, 5, True) in found and (5, 1, 1, 1, False) in found
    assert {r[2] for r in found if r[0] in (7, 8)} == {3}
    assert {r[3] for r in found if r[0] in (7, 8)} == {7}


def test_bands_reach_the_recall():
    miss = (1 - 0.8**ngram_join.ROWS_PER_BAND) ** ngram_join.BANDS
    assert miss <= 1 - ngram_join.TARGET_RECALL


def vectors():
    rnd = np.random.default_rng(3)
    rows, at = [], 0
    for cluster in range(25):
        centre = rnd.standard_normal(16)
        for _ in range(60 if cluster == 0 else 1 + cluster % 4):
            v = centre + rnd.standard_normal(16) * rnd.choice([0.0, 0.1, 0.25])
            rows.append((at, v.tolist(), cluster % 3))
            at += 1
    rows += [(at + 1, [0.0] * 16, 1), (at + 2, None, 1), (at + 3, [1.0] * 16, None), (at + 4, [], 1),
             (at + 5, [float("nan")] * 16, 1), (at + 6, [1.0, None], 1), (at + 7, [1.0, 2.0], 1),
             (at + 8, [2.0, 4.0], 1), (at + 9, [1e300, 2e300], 1)]
    return rows


@pytest.mark.parametrize("chunk", [512, 9])
def test_embedding_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rows = vectors()
    good = [(i, np.array(v), label) for i, v, label in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for n, (a, v, x) in enumerate(good):
        for b, w, y in good[n + 1 :]:
            if x == y and len(v) == len(w):
                v1, w1 = v / np.abs(v).max(), w / np.abs(w).max()
                if v1 @ w1 / np.sqrt((v1 @ v1) * (w1 @ w1)) >= 0.93:
                    links.append((a, b))
    wanted, degree = groups([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows],
                               "vec_id long, embedding array<double>, label int, node string, links int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_links for i, r in got.items()} == degree
    assert {i for i, r in got.items() if r.kept} == set(wanted.values())


def test_embedding_copies_and_nulls(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (5, 0, 5)]
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


def cone(rows, pairs, width=32, cosine=0.8):
    """Unit vectors of one mean direction with these mean cosines, the first ones with a partner at 0.935."""
    rnd = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis = unit(rnd.standard_normal(width))
    out = unit(axis * cosine**0.5 + unit(rnd.standard_normal((rows, width))) * (1 - cosine) ** 0.5)
    side = rnd.standard_normal((pairs, width))
    side = unit(side - (side * out[:pairs]).sum(axis=1, keepdims=True) * out[:pairs])
    return np.concatenate([out, 0.935 * out[:pairs] + (1 - 0.935**2) ** 0.5 * side])


def cone_links(spark, rows, pairs):
    """Wanted and found link ends of a table whose vectors share a mean direction."""
    all_rows = cone(rows, pairs)
    near = all_rows @ all_rows.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(all_rows)],
                               "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df).collect()}
    return near.sum(axis=1), np.array([got[i] for i in range(len(all_rows))])


def passes_of(spark, table):
    """The largest number of passes and the number of hard vectors of a table of one label."""
    teams = spark.createDataFrame([("1", i, v.tolist()) for i, v in enumerate(table)],
                                  "team string, node long, vector array<double>")
    sizes = teams.groupBy("team").agg(F.count("*").alias("n"))
    row = embedding_dedup._planned(teams, sizes, Staging(spark, "test")).agg(
        F.max("passes").alias("passes"), F.count_if("hard").alias("hard")).first()
    return row.passes, row.hard


def test_embedding_cone_by_passes(spark):
    """At real settings a crowded team takes more passes than an even one, and hardly any blocks."""
    wanted, got = cone_links(spark, 4000, 300)
    assert np.abs(wanted - got).sum() <= 0.0005 * wanted.sum()
    passes, hard = passes_of(spark, cone(4000, 300))
    assert passes > embedding_dedup.passes_for(4300) and hard < 10


def test_embedding_small_label_is_one_pass(spark):
    wanted, got = cone_links(spark, 40, 10)
    assert (wanted == got).all()
    assert passes_of(spark, cone(40, 10)) == (1, 0)
    assert passes_of(spark, cone(60, 20))[0] > 1


def test_embedding_runs_of_equal_numbers_meet_in_blocks(spark):
    """Vectors in almost one direction share all signs: no window holds them."""
    rnd = np.random.default_rng(5)
    table = np.concatenate([cone(150, 20), 1 + 1e-13 * rnd.standard_normal((300, 32))])
    near = (unit := table / np.linalg.norm(table, axis=1, keepdims=True)) @ unit.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(table)],
                               "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df).collect()}
    assert [got[i] for i in range(len(table))] == near.sum(axis=1).tolist()
    passes, hard = passes_of(spark, table)
    assert passes > 0 and hard > 100


def test_plan_leaves_crowded_vectors_to_the_blocks():
    n = 10**6
    even, cut = embedding_dedup.plan(n, {7: n})
    assert 0 < even < 100 and cut == 8
    assert embedding_dedup.plan(n, {7: n - 10, embedding_dedup.NEVER: 10}) == (even, cut)
    assert embedding_dedup.plan(n, {embedding_dedup.NEVER: n}) == (0, 0)
    assert embedding_dedup.plan(n, {7: n // 2, 16: n // 2})[0] > even
    assert embedding_dedup.plan(n, {7: n // 2, 40: n // 2}) == (even, cut)


def test_window_passes_grow_with_the_table():
    assert embedding_dedup.passes_for(10) <= embedding_dedup.passes_for(10_000) < embedding_dedup.passes_for(10**7)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_cover_edge_cases(spark, docs, no_docs, module, label):
    bad = {"quality": 0, "toxic": 1}[label]
    texts = [(i, ("### " * 30 if label == "quality" else "scumlo ") + prose(i, 60) if i % 4 == 0 else prose(i, 60), i % 4 == 0)
             for i in range(600)]
    table = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad if odd else 1 - bad) for i, _, odd in texts] + [(None, 1), (1, None)],
                                   f"doc_id long, {label} int")
    got = {r.doc_id: r for r in module.classify(table, labels).collect()}
    held = [(got[i], bad if odd else 1 - bad) for i, _, odd in texts if got[i].held_out]
    assert len(held) > 50 and sum(r.predicted == y for r, y in held) > 0.95 * len(held)
    edge = module.classify(docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert module.classify(no_docs, labels).count() == 0
    untrained = module.classify(docs, labels.where("false")).collect()
    assert len({r.score for r in untrained}) == 1


def test_factorisation_identity():
    """The sum-of-squares form equals the sum over all pairs."""
    import pyarrow as pa

    machine = quality.FactorisationMachine(quality.BUCKETS + 16)
    found = quality.Features(pa.array(["some words here", None, "x"]))
    got = machine.margin(found)
    for r in range(3):
        at = slice(found.bounds[r], found.bounds[r + 1])
        i, v = found.index[at], found.value[at]
        pairs = sum(
            machine.factors[i[a]] @ machine.factors[i[b]] * v[a] * v[b]
            for a in range(len(i)) for b in range(a)
        )
        assert got[r] == pytest.approx(machine.linear[i] @ v + pairs)


def test_pipeline_stages(spark, docs, no_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert stage(spark, no_docs, SF_DIR).count() == 0
        rows = Staging(spark, "stage").write(after)
    assert "ids" in rows.columns


def test_pipeline_over_a_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, SF_DIR)
    before = queries.table(spark, SF_DIR, "documents")
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(ids) < before.count() and out.where("size(ids) <> n_tokens").count() == 0


def test_training_rows_take_a_share_of_the_rare_label(spark):
    ids = range(2000)
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i in ids for t in ("b", f"a{i}")], "doc_id long, text string")
    for share, low, high in ((None, 5, 30), (0.25, 35, 65)):
        rows = features.training_rows(docs, labels, "toxic", F.lit(True), 200, share).collect()
        assert 150 <= len(rows) <= 250 and len({r.doc_id for r in rows}) == len(rows)
        assert low <= sum(r.label for r in rows) <= high
        assert all(r.text == f"a{r.doc_id}" for r in rows)
    rows = features.training_rows(docs.limit(0), labels.limit(0), "toxic", F.lit(True), 200, 0.5)
    assert rows.count() == 0
