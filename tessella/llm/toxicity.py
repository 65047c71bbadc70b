"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over an inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, small_batches, texts_of, tidy
from .decontaminate import TABLE

#: Labelled rows that the examples are drawn from, at most: those of least hash.
MAX_EXAMPLES = 20_000
#: Terms of the vectors: those that tell the labels of the examples apart, for either label, in so many
#: examples at least. The chi-square (one degree of freedom) is that of one error in twenty over a million
#: terms tried. There is no cap on their number.
MIN_CHI2, MIN_SUPPORT = 30.0, 4
#: Examples in a block of the index.
BLOCK = 64
#: Neighbours that vote.
NEIGHBOURS = 25
#: Lengths of the word beginnings that are terms beside the words.
STEMS = (4, 5, 6, 7)
#: Weight of the prior in a vote.
PRIOR_WEIGHT = 0.25
#: Words whose terms a worker remembers, and terms that a task counts before it passes the counts on.
REMEMBERED, COUNTED = 120_000, 100_000


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the id's decimal digits is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split() if text else []


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings (marked), the terms that it counts for."""
    w = word.decode("utf-8", "ignore")
    return [word, *(f"^{w[:n]}".encode() for n in STEMS if len(w) > n)]


class TermIds(dict):
    """From a word to the numbers of its terms in the vocabulary; remembers words."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(i for t in terms_of(word) if (i := self.vocabulary.get(t)) is not None)
        if len(word) < 64:
            self[word] = found
        return found

    def counts(self, text: str | None) -> Counter:
        return Counter(i for ids in filter(None, map(self.__getitem__, words(text))) for i in ids)


@dataclass
class Model:
    """Examples as unit vectors, with a block-max index: each term's largest weight in every block of examples.

    Examples lie in order of their heaviest term, so that a block's vectors are alike and its maxima tight.
    """

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray  # of the examples, as evidence
    ptr: np.ndarray = field(default=None)
    term: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    block_ptr: np.ndarray = field(default=None)  # of each term: its blocks, and its largest weight in each
    block: np.ndarray = field(default=None)
    top: np.ndarray = field(default=None)
    prior: float = 0.0
    blank: float = 0.0
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
        tf = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        order = np.argsort(t)
        t, w = t[order], ((1 + np.log(tf)) * self.idf[t])[order]
        norm = np.sqrt((w * w).sum())
        return t, w / norm if norm else w

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
        self.term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        self.weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        block = np.repeat(np.arange(len(vectors)), np.diff(self.ptr)) // BLOCK
        order = np.lexsort((block, self.term))
        t, b = self.term[order], block[order]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (b[1:] != b[:-1]))) if len(t) else np.zeros(0, np.int64)
        self.block, self.top = b[first], np.maximum.reduceat(self.weight[order], first) if len(t) else self.weight
        self.block_ptr = np.searchsorted(t[first], np.arange(len(self.idf) + 1))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, exactly; ties go to the lower place.

        No example of a block is nearer than the block's bound, the sum of its terms' maxima. Blocks
        are compared in order of their bounds until the next bound is below the k-th cosine.
        """
        n = len(self.ptr) - 1
        if not n or not len(t):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at, size = _ranges(self.block_ptr[t], self.block_ptr[t + 1])
        bound = np.bincount(self.block[at], self.top[at] * np.repeat(w, size), minlength=-(-n // BLOCK))
        order = np.argsort(-bound, kind="stable")
        bound = bound[order] + 1e-9
        query = np.zeros(len(self.idf))
        query[t] = w
        place, got = np.zeros(0, dtype=np.int64), np.zeros(0)
        least, done, step = 1e-9, 0, 4
        while done < len(order) and bound[done] > least:
            some = order[done : done + step]
            some = np.sort(some[bound[done : done + step] > least])
            rows, _ = _ranges(some * BLOCK, np.minimum(some * BLOCK + BLOCK, n))
            at, size = _ranges(self.ptr[rows], self.ptr[rows + 1])
            cosine = np.add.reduceat(query[self.term[at]] * self.weight[at], np.cumsum(size) - size)
            near = (cosine > 0) & (rows != skip)
            place, got = np.append(place, rows[near]), np.append(got, cosine[near])
            best = np.lexsort((place, -got))[:k]
            place, got = place[best], got[best]
            if len(got) == k:
                least = float(got[-1])
            done, step = done + step, step * 2
        return place, got

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (1.02 - np.minimum(cosine, 1.0))
        near = PRIOR_WEIGHT * w.max() if len(w) else 1.0
        return float((near * self.prior + (w * self.labels[place]).sum()) / (near + w.sum()))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))

    def score(self, counts: Counter) -> tuple[float, list[int]]:
        """Score and the ids of the nearest examples."""
        if not counts:
            return self.blank, []
        place, cosine = self.nearest(*self.vector(counts))
        return self.calibrated(self.vote(place, cosine)), self.ids[place[:3]].tolist()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [lo, hi), one after another, and the size of each."""
    size = hi - lo
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Knots of the isotonic regression of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, size
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    knots = [(p[0] / p[2], (p[1] + 0.1) / (p[2] + 0.2)) for p in pools]
    ys = np.maximum.accumulate([b for _, b in knots]) if knots else []
    return tuple(a for a, _ in knots) or (0.0, 1.0), tuple(map(float, ys)) if len(ys) else (0.0, 1.0)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, clean documents), summed over many documents."""
    by: tuple[Counter, Counter] = (Counter(), Counter())

    def passed_on() -> pa.RecordBatch:
        some = list(by[0].keys() | by[1].keys())
        columns = [pa.array(some, pa.binary()), *(pa.array([c[t] for t in some], pa.int64()) for c in (by[1], by[0]))]
        for c in by:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    for batch in batches:
        for part in chunked(batch, 0):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by[label].update({t for w in set(words(text)) for t in terms_of(w)})
                if len(by[0]) + len(by[1]) > COUNTED:
                    yield passed_on()
    yield passed_on()


def labelled(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, text, label) of the training fold: at most ``max_examples`` labelled rows, of least hash.

    A document with several labels is toxic if one says so; null labels are ignored.
    """
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label")
    )
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(own), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Choose terms that tell the labels apart, weigh them over all documents, index the examples.

    The driver gets at most ``max_examples`` sparse examples and the terms that tell their labels
    apart, whose number the examples bound. Document frequencies are counted over every document.
    Examples vote on each other, each left out in turn, on the executors.
    """
    small_batches(docs.sparkSession)
    examples = labelled(docs, labels, max_examples)
    sums = (
        examples.select("text", "label").mapInArrow(tidy(_label_counts), "term binary, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    )
    n1, n0 = (examples.agg(F.sum("label"), F.sum(1 - F.col("label"))).first() or (0, 0))
    n1, n0 = n1 or 0, n0 or 0
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n, c, d = float(n1 + n0), F.lit(float(n1)) - a, F.lit(float(n0)) - b
    chi2 = F.lit(n) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * float(n1 or 1) * float(n0 or 1), F.lit(1.0))
    best = (
        sums.where(F.col("a") + F.col("b") >= MIN_SUPPORT).withColumn("x", chi2).where(F.col("x") >= MIN_CHI2)
        .orderBy(F.desc("x"), "term").select("term").collect()
    )
    vocabulary = {bytes(r[0]): i for i, r in enumerate(best)}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        ids, seen, rows = TermIds(shared.value), np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            for part in chunked(batch, 0):
                for text in part.column(0).to_pylist():
                    rows += 1
                    for i in ids.counts(text):
                        seen[i] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], rows), pa.int64())], names=["i", "df"]
        )

    df = np.zeros(len(vocabulary) + 1)
    counted = docs.select("text").mapInArrow(tidy(frequencies), "i long, df long").groupBy("i").agg(F.sum("df").alias("df"))
    for i, x in counted.collect():
        df[i] = x
    total, df = df[-1], df[:-1]
    idf = np.log((1 + total) / (1 + df)) + 1

    def sparse(batches):
        ids = TermIds(shared.value)
        for batch in batches:
            for part in chunked(batch, 1):
                counts = [ids.counts(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([list(x.keys()) for x in counts], pa.list_(pa.int32())),
                        pa.array([list(x.values()) for x in counts], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "label", "t", "n"],
                )

    rows = examples.select("doc_id", "text", "label").mapInArrow(tidy(sparse), "doc_id long, label int, t array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.t, r.n))
    blank = [r.label for r in rows if not r.t]
    rows = [r for r in rows if r.t]
    vectors = Model(vocabulary, idf, np.zeros(0), np.zeros(0))
    made = [vectors.vector(Counter(dict(zip(r.t, r.n, strict=True)))) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (int(made[i][0][np.argmax(made[i][1])]), -float(made[i][1].max()), rows[i].doc_id, i))
    rows = [rows[i] for i in order]
    model = Model(vocabulary, idf, np.array([r.label for r in rows], dtype=np.float64), np.array([r.doc_id for r in rows], dtype=np.int64))
    model.index([made[i] for i in order])
    model.prior = float((n1 + 0.5) / (n1 + n0 + 1)) if n1 + n0 else 0.0
    model.blank = float((sum(blank) + 0.5) / (len(blank) + 1)) if blank else model.prior
    if len(rows) > 1:
        model.knots = _monotone(_votes_on_each_other(docs.sparkSession, model), model.labels)
    return model


def _votes_on_each_other(spark: SparkSession, model: Model) -> np.ndarray:
    """The vote on each example by the others; one number an example comes back."""
    shared = spark.sparkContext.broadcast(model)
    n = len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            own = [model.vote(*model.nearest(*(x[model.ptr[i] : model.ptr[i + 1]] for x in (model.term, model.weight)), skip=i)) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["id", "vote"])

    out = np.zeros(n)
    for i, vote in spark.range(0, n, 1, max(1, min(64, n // 256))).mapInArrow(tidy(run), "id long, vote double").collect():
        out[i] = vote
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the document's columns, or those of ``keep``), ``_score`` in [0, 1] and ``_evidence`` (example ids).

    A text without any of the model's terms, such as a null or empty one, gets the share of toxic
    ones among such examples. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids = TermIds(model.vocabulary)
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                got = [model.score(ids.counts(x)) for x in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"),
                        pa.array([s for s, _ in got], pa.float64()),
                        pa.array([e for _, e in got], pa.list_(pa.int64())),
                    ],
                    names=["_row", "_score", "_evidence"],
                )

    rows = texts_of(docs, text_col, keep=keep)
    schema = rows.select("_row", F.lit(0.0).cast("double").alias("_score"), F.array().cast("array<long>").alias("_evidence")).schema
    return rows.mapInArrow(tidy(run), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document; see the query ``op6_toxicity``."""
    return score(docs, fit(docs, labels), keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        held_out("_row.doc_id").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_evidence").alias("evidence"),
    )
