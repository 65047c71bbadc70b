"""Each stage of the pipeline, and the score of operator 6, against plain versions."""

import math
import random
import zlib
from collections import Counter

import pytest
from test_text_operators import WORD, brute_components, brute_print, lower, sha

from tessella.llm import toxicity


def plain_scores(rows, labels):
    """Scores of texts by (id, text) rows and {id: label}: terms, weights, neighbours, vote and calibration, one by one."""

    def counts(text):
        c = Counter()
        for w in WORD.findall(lower(text or "")):
            for t in {w} | {"^" + w[:n] for n in (4, 5, 6, 7) if len(w) > n}:
                c[t] += 1
        return c

    own = [(i, counts(t), labels[i]) for i, t in rows if t is not None and i in labels and zlib.crc32(str(i).encode()) % 5]
    n1, n = sum(y for *_, y in own), len(own)
    if not n:
        return [0.0] * len(rows)
    terms = []
    for t in sorted({t for _, c, _ in own for t in c}):
        a, b = (sum(t in c and y == k for _, c, y in own) for k in (1, 0))
        c, d = n1 - a, n - n1 - b
        if a + b >= 4 and n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * max(n1, 1) * max(n - n1, 1), 1) >= 30:
            terms.append(t)
    every = [counts(t) for _, t in rows]
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in c for c in every))) + 1 for t in terms}

    def vector(c):
        v = {t: (1 + math.log(c[t])) * idf[t] for t in terms if c[t]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = [(vector(c), y) for _, c, y in own]
    blank = [y for v, y in examples if not v]
    examples = [(v, y) for v, y in examples if v]
    prior = (n1 + 0.5) / (n + 1)

    def vote(v, skip=None):
        got = [(sum(x * u.get(t, 0.0) for t, x in v.items()), y) for i, (u, y) in enumerate(examples) if i != skip]
        got = sorted((g for g in got if g[0] > 0), key=lambda g: -g[0])
        cut = got[24][0] if len(got) > 24 else 0.0
        ties = {y for c, y in got if abs(c - cut) < 1e-12}
        near = [(1 / (1.02 - min(c, 1.0)), y) for c, y in got[:25]]
        w = 0.25 * max((x for x, _ in near), default=4.0)
        return (w * prior + sum(x * y for x, y in near)) / (w + sum(x for x, _ in near)), len(got) <= 25 or len(ties) == 1

    votes = [(vote(v, i)[0], y) for i, (v, y) in enumerate(examples)]
    pools = []
    for x, y in sorted(votes, key=lambda p: p[0]):
        pools.append([x, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    xs, ys = [p[0] / p[2] for p in pools], [(p[1] + 0.1) / (p[2] + 0.2) for p in pools]
    ys = [max(ys[: i + 1]) for i in range(len(ys))]

    def score(c):
        v = vector(c)
        if not v:
            return (sum(blank) + 0.5) / (len(blank) + 1) if blank else prior
        x, _ = vote(v)
        if x <= xs[0]:
            return ys[0]
        for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
            if x <= x1:
                return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        return ys[-1]

    return [score(c) for c in every]


def toxic_texts():
    r = random.Random(3)
    out = []
    for i in range(260):
        t = [f"{r.choice('abcdefgh')}{r.randrange(40)}x{r.random():.12f}" for _ in range(r.randint(8, 30))]
        bad = i % 4 == 0
        t += [r.choice(["vile", "foulness", "nasty"]) for _ in range(r.randint(1, 3))] if bad else [r.choice(["kindly", "gentle"])]
        r.shuffle(t)
        out.append((" ".join(t), int(bad)))
    return out


def test_scores_from_a_plain_version(frame, spark):
    """Also with fewer examples than neighbours, so that no tie decides who votes, and in rows with equal cosines."""
    for n in (260, 24):
        made = toxic_texts()[:n]
        texts = [t for t, _ in made] + [None, "", made[0][0], "x " * 20_000 + "vile"]
        docs = frame(texts)
        labels = {i: y for i, (_, y) in enumerate(made)}
        table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
        got = {r.doc_id: r.score for r in toxicity.report(docs, table).collect()}
        want = plain_scores(list(enumerate(texts)), labels)
        close = [abs(got[i] - w) < (1e-9 if n == 24 else 0.02) for i, w in enumerate(want)]
        assert sum(close) >= (len(want) if n == 24 else 0.95 * len(want))
        assert sum((got[i] >= 0.5) != (w >= 0.5) for i, w in enumerate(want)) <= (0 if n == 24 else 2)


@pytest.fixture(scope="module")
def corpus(hard, hard_texts, spark, tmp_path_factory):
    """The hard documents and toxic ones with labels and a benchmark, as a folder of tables."""
    folder = tmp_path_factory.mktemp("corpus")
    made = toxic_texts()
    shared = hard_texts[19]
    lines = [("site line\n" if i < 12 else "few line\n") + f"own {i} {i * i}" for i in range(16)]
    more = spark.createDataFrame(
        [(1000 + i, t, "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(made)] + [(2000 + i, t, None, f"t{i}", None) for i, t in enumerate(lines)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    extra = [c for c in hard.columns if c not in more.columns]
    docs = hard.unionByName(more.selectExpr("*", "1 as _row", "'x' as _text", "0L as _id", "0L as _t", "'k' as _kept", "2 as n", "3 as a", "4L as _fp", "'b' as label"))
    assert len(extra) == 9
    spark.createDataFrame([(1000 + i, 1, y) for i, (_, y) in enumerate(made)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, shared[:200]), (2, "only two"), (3, None), (4, ""), (None, "a b"), (5, "few line own 12")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder), bench


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages(spark, corpus):
    import corpus_pipeline as P

    docs, folder, bench = corpus
    by = dict(P.STAGES)
    assert [k for k, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontaminate", "bpe"]
    every = docs.collect()

    # toxicity: what the plain score rejects goes; nothing near the border is in these documents
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scores = plain_scores([(r.doc_id, r.text) for r in every], labels)
    got = rows_of(by["toxicity"](spark, docs, folder))
    want = sorted(repr(tuple(r)) for r, s in zip(every, scores, strict=True) if s < 0.5)
    assert got == want and 20 < len(every) - len(want) < 100

    # line dedup: lines of ten sites go, and n_chars follows
    sites = {}
    for r in every:
        for x in (r.text or "").split("\n"):
            if r.source is not None and x.strip(" \t\r"):
                sites.setdefault(x.strip(" \t\r"), set()).add(r.source)
    want = []
    for r in every:
        d = r.asDict()
        if r.text is not None:
            d["text"] = "\n".join(x for x in r.text.split("\n") if len(sites.get(x.strip(" \t\r"), ())) < 10)
            d["n_chars"] = r.n_chars if d["text"] == r.text else len(d["text"])
        want.append(repr(tuple(d[c] for c in docs.columns)))
    assert rows_of(by["line_dedup"](spark, docs, folder)) == sorted(want)
    assert len(sites["site line"]) >= 10 > len(sites["few line"])

    # SimHash: of each component the least id stays, once
    prints = [brute_print(r.text) for r in every]
    roots = brute_components(prints)
    groups = {}
    for r, p in zip(every, prints, strict=True):
        groups.setdefault(roots[p], []).append(r)
    kept = by["simhash_near_dedup"](spark, docs, folder).collect()
    assert len(kept) == len(groups)
    chosen = Counter(roots[brute_print(r.text)] for r in kept)
    assert set(chosen.values()) == {1}
    for r in kept:
        ids = [x.doc_id for x in groups[roots[brute_print(r.text)]] if x.doc_id is not None]
        assert r.doc_id == (min(ids) if ids else None) and tuple(r) in {tuple(x) for x in every}

    # decontamination: documents of which a twentieth is benchmark go
    windows = set()
    for i, t in bench:
        w = WORD.findall(lower(t or "")) if i is not None else []
        k = min(13, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1 if k else 0)}
    want = []
    for r in every:
        w, hit = WORD.findall(lower(r.text or "")), set()
        for win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(repr(tuple(r)))
    assert rows_of(by["decontaminate"](spark, docs, folder)) == sorted(want) and len(want) < len(every)

    # tokens: the library's
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = []
    for r in every:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert rows_of(by["bpe"](spark, docs, folder)) == sorted(map(repr, want))


def test_run(spark, corpus):
    """The whole run is the stages one after another."""
    import corpus_pipeline as P

    docs, folder, _ = corpus
    for _, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, folder).persist()
        if stage is not P.STAGES[-1][1]:
            assert docs.dtypes == before.dtypes
    assert rows_of(P.run(spark, folder)) == rows_of(docs)


def test_pipeline_on_nothing(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, data).count() == 0
