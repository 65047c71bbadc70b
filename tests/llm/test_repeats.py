"""Substring and suffix dedup against brute force."""

import hashlib
from collections import Counter

import pytest

from tessella.llm import repeats, substring, suffix


def brute(docs, units, window, join):
    """(n, removed, runs, kept) of each document from all windows."""
    cut = [units(t) for t in docs]
    seen = Counter(tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window] for u in cut for i in range(len(u) - window + 1))
    out = []
    for u in cut:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), runs, join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out


def words(t):
    return (t or "").encode().split()


def test_substrings(hard):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    want = brute([t for _, t in rows], words, 35, b" ".join)
    want = sorted((i, n, m, hashlib.sha256(k).hexdigest()) for (i, _), (n, m, _, k) in zip(rows, want, strict=True) if i is not None)
    got = [tuple(r) for r in substring.report(hard).collect()]
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(rows)
    assert sum(m for _, _, m, _ in want) > 5000


def test_suffixes(hard):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    want = brute([t for _, t in rows], lambda t: (t or "").encode(), 400, bytes)
    want = sorted((i, n, m, k, hashlib.sha256(x).hexdigest()) for (i, _), (n, m, k, x) in zip(rows, want, strict=True) if i is not None)
    got = [tuple(r) for r in suffix.report(hard).collect()]
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(rows)


@pytest.mark.parametrize("module", [substring, suffix])
def test_groups_in_parts_give_the_same(module, hard, monkeypatch, spark):
    want = sorted(map(repr, module.report(hard).collect()))
    monkeypatch.setattr(repeats, "GROUP_ROWS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        # the workers pickle the module by reference, so walk here in this process
        import numpy as np

        rng = np.random.default_rng(0)
        a = np.sort(rng.integers(0, 6, 60))
        b = rng.integers(0, 3, 60)
        order = np.lexsort([b, a])
        a, b = a[order], b[order]
        cols = [a, b, np.arange(60), np.zeros(60, int), np.arange(60, dtype=np.int32), np.zeros(60, np.int8)]
        whole = {int(x) for r in repeats._settle_windows(cols, False) for x in r.column("p").to_pylist()}
        batches = [repeats._record(repeats.ROW, *(c[i : i + 7] for c in cols)) for i in range(0, 60, 7)]
        parts = {int(x) for r in repeats._walk(iter(batches), repeats._settle_windows) for x in r.column("p").to_pylist()}
        assert whole <= parts
        again = sorted(map(repr, module.report(hard).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == want


@pytest.mark.parametrize("module", [substring, suffix])
def test_texts_in_buckets_give_the_same(module, hard, monkeypatch):
    want = sorted(map(repr, module.report(hard).collect()))
    monkeypatch.setattr(repeats, "FEW", 0)
    got = module.report(hard)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert sorted(map(repr, got.collect())) == want


def test_difference_cover():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))


@pytest.mark.parametrize("module", [substring, suffix])
def test_empty_table(module, hard):
    assert module.report(hard.where("false")).collect() == []


def test_many_sharers(frame):
    """A passage in hundreds of documents, whose surroundings differ."""
    import random

    r = random.Random(4)
    passage = " ".join(f"w{i}" for i in range(110))
    texts = [" ".join(f"u{r.randrange(10**9)}" for _ in range(r.randrange(70))) + " " + passage + " " + " ".join(f"v{r.randrange(10**9)}" for _ in range(50)) for _ in range(400)]
    df = frame(texts)
    assert {r.n_removed for r in substring.report(df).collect()} == {110}
    n = len(passage.encode())
    assert all(n <= r.n_removed <= n + 16 for r in suffix.report(df).collect())


def thue_morse(n):
    """Two words that any polynomial hash modulo 2**64 with an odd base sends to one value."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))


def test_words_that_polynomials_confuse(frame):
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [f"{w} {rest}" for w in thue_morse(4096)] + [f"x {w[:600]} y" for w in thue_morse(4096)]
    assert {r.n_removed for r in substring.report(frame(texts)).collect()} == {0}
    want = brute(texts, lambda t: t.encode(), 400, bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.report(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [w[:3] for w in want]
