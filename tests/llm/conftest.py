"""Documents that are hard to handle, for every operator."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, start=0, sources=("a", "b", "c")):
        rows = [(start + i, t, None if i % 3 == 0 else "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty and blank texts, odd bytes, long texts, copies, near copies, shared passages."""
    shared = prose(1, 60)
    long = prose(2, 6000)
    return [
        None, "", "   \n\t ", "one", "a b", "ÉÀ ñ ß İ Σς", "\x00\x01 \x1c\x1f \x85  x", "x" * 5000, "ab " * 900,
        prose(3, 200), prose(3, 200), shared + " " + prose(4, 80), prose(5, 80) + " " + shared, prose(6, 30) + "\n" + shared + "\n" + prose(7, 30),
        long, long[:9000] + " edit " + long[9000:], prose(8, 34), prose(9, 35), prose(9, 35), shared, shared[:300] + shared[:300],
        "<|endoftext|> it's <|startoftext|>x 12 345 we'll", "\U0001f600 tag 日本語 abc", "é" * 700, "é" * 700,
    ]


@pytest.fixture(scope="session")
def hard(spark, frame, hard_texts):
    """The texts as a table with null ids, repeated rows and ids, and columns that clash with inner names."""
    df = frame(hard_texts)
    extra = spark.createDataFrame([(None, "no id", "en", None, 5), (None, None, None, None, None), (3, "one", None, "a", 3), (3, "other", None, "a", 5)], DOCS)
    more = df.unionByName(extra)
    return more.selectExpr("*", "1 as _row", "'x' as _text", "0L as _id", "0L as _t", "'k' as _kept", "2 as n", "3 as a", "4L as _fp", "'b' as label")
