"""Embedding near-dedup, toxicity and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity, vectors


def brute(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, n[i], least[find(i)], k == least[find(i)]) for i, (k, _, _) in enumerate(rows))


def made(seed, centres, each, spread, d=16):
    r = np.random.default_rng(seed)
    out = []
    for c in range(centres):
        m = r.normal(size=d)
        for _ in range(each):
            out.append((m + spread * r.normal(size=d) * np.linalg.norm(m) / np.sqrt(d)).tolist())
    return out


@pytest.mark.parametrize("piece", [vectors.PIECE, 7])
def test_links(spark, piece, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", piece)
    vs = made(1, 12, 14, 0.25)
    vs += [vs[0], vs[0], [2 * x for x in vs[0]], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, []]
    rows = [(i, v, None if i % 29 == 5 else i % 3) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as k", "2 as n", "3 as v")
    assert sorted(tuple(r) for r in vectors.near_vectors(df).collect()) == brute(rows)
    assert vectors.near_vectors(df.where("false")).collect() == []
    assert len(vectors.near_vectors(df.where("embedding is null")).collect()) == 1


def test_links_of_each_length(spark):
    vs = made(2, 3, 5, 0.1) + made(3, 2, 4, 0.1, d=5) + made(4, 1, 1, 0.1, d=17) + [[1.0], [2.0], [-1.0]]
    rows = [(i, v, 0) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in vectors.near_vectors(df).collect()) == brute(rows)


def test_rows_written_follow_the_vectors(spark, monkeypatch):
    written, stash = [], vectors.stash

    def counted(df):
        written.append(stash(df))
        return written[-1]

    monkeypatch.setattr(vectors, "stash", counted)
    vs = np.random.default_rng(5).normal(size=(600, 64)).tolist()
    vs += vs[:3]
    rows = [(i, v, 0) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sum(r.n_links for r in vectors.near_vectors(df).collect()) == 6
    assert sum(w.count() for w in written) <= 2 * len(vs)


def test_links_of_many_copies_and_cells():
    r = np.random.default_rng(7)
    v = np.concatenate([r.normal(size=(300, 16)), r.normal(size=16) + 0.01 * r.normal(size=(900, 16))])
    geo = vectors.Geometry(16, 0.93)
    u = geo.unit(v)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    for at_once in (vectors.AT_ONCE, 1000):
        vectors_at_once, vectors.AT_ONCE = vectors.AT_ONCE, at_once
        n, root = vectors._label_links(geo, v, np.ones(len(v), dtype=int), None)
        vectors.AT_ONCE = vectors_at_once
        assert (n == near.sum(1)).all()
        assert len(set(root[300:])) == 1


def test_pigeonhole():
    geo = vectors.Geometry(64, 0.93)
    r = np.random.default_rng(0)
    for _ in range(200):
        u = r.normal(size=64)
        w = r.normal(size=64)
        u, w = u / np.linalg.norm(u), w - (w @ u) * u / (u @ u)
        w = 0.9301 * u / np.linalg.norm(u) + np.sqrt(1 - 0.9301**2) * w / np.linalg.norm(w)
        gap = geo.block_distances(((u - w) @ geo.turn)[None])[0]
        assert (gap <= geo.budget).any()


@pytest.fixture(scope="module")
def labelled(frame, spark):
    import random

    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(700):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = r.choice(["vile", "foul", "nasty"])
        texts.append(" ".join(t))
        toxic.append(int(bad))
    texts += [None, ""]
    docs = frame(texts).selectExpr("*", "1 as label", "2 as t")
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)] + [(None, 1, 1), (3, 0, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, dict(enumerate(toxic))


def test_toxicity(labelled):
    docs, labels, toxic = labelled
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.predicted == toxic[r.doc_id] for r in held) and len(held) > 100
    assert {r.predicted for r in rows if r.doc_id >= 700} == {0}


@pytest.mark.parametrize("every", [2, 3])
def test_toxicity_at_any_share_of_labels(frame, spark, every):
    """Half and two thirds of the labels toxic: the words that tell the labels apart still decide."""
    import random

    r = random.Random(8)
    toxic = [int(i % every > 0) for i in range(700)]
    texts = [" ".join([f"w{r.randrange(400)}" for _ in range(r.randint(5, 60))] + (["vile", "foul"] if bad else ["mild", "kind"])) for bad in toxic]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = toxicity.report(frame(texts), labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(r.predicted == toxic[r.doc_id] for r in held)


def test_clean_words_vote(frame, spark):
    """A text with a word that is mostly toxic isn't toxic where words that speak for label 0 surround it."""
    import random

    r = random.Random(9)
    clean, texts, toxic = ["novel", "review", "chapter", "author"], [], []
    for i in range(1200):
        t = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 20))]
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            t += ["vile"]
        elif i % 2:
            t += clean + (["vile"] if i % 12 == 1 else [])
        texts.append(" ".join(t))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = frame(texts)
    model = toxicity.fit(docs, labels)
    assert {b"vile", *(x.encode() for x in clean)} <= model.vocabulary.keys()
    held = [r for r in toxicity.score(docs, model).where(toxicity.held_out("_row.doc_id")).collect()]
    assert len(held) > 100 and all((r._score >= 0.5) == toxic[r._row.doc_id] for r in held)


def test_labels_outside_the_training_fold_change_nothing(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(repr, toxicity.report(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_nearest_is_exact(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    n = len(model.ptr) - 1
    dense = np.zeros((n, len(model.idf)))
    for i in range(n):
        dense[i, model.term[model.ptr[i] : model.ptr[i + 1]]] = model.weight[model.ptr[i] : model.ptr[i + 1]]
    r = np.random.default_rng(1)
    for _ in range(50):
        t = np.sort(r.choice(len(model.idf), min(3, len(model.idf)), replace=False))
        w = r.random(len(t))
        place, cosine = model.nearest(t, w, 10)
        got = dense[:, t] @ w
        order = [i for i in np.lexsort((np.arange(n), -got)) if got[i] > 0][:10]
        assert np.allclose(got[order], cosine) and np.allclose(got[place], cosine)


def test_no_labels(labelled, spark):
    docs, labels, _ = labelled
    rows = toxicity.report(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    assert toxicity.report(docs.where("false"), labels).collect() == []
