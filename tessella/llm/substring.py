"""Substring dedup over words, with difference-cover anchors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, Digests, Words, doubled, mix
from .repeats import remove_repeats

#: Words in a window.
WINDOW = 35
#: A perfect difference set: every difference modulo the period is one of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

_words = Digests()


@dataclass(frozen=True)
class CoverSpec:
    """Anchors are word runs that start at cover positions modulo the period.

    For windows that start at i and j there is a d below the period with i+d and j+d both cover
    positions, so equal windows of w words share an equal run of w - period + 1 words at d.
    """

    window: int = WINDOW
    #: A hull holds few windows, which are named one by one.
    levels: tuple[int, ...] = ()

    @property
    def reach(self) -> int:
        return PERIOD - 1

    @property
    def run(self) -> int:
        return self.window - PERIOD + 1

    def units(self, texts: list[bytes | None]) -> Words:
        return Words(texts)

    def _runs(self, w: Words, n: int, k: int) -> np.ndarray:
        """Hash of every ``n`` consecutive words, from XXH3 of the words' bytes."""
        if not hasattr(w, "runs"):
            w.runs = {0: w.digests(_words)}
        if (n, k) not in w.runs:
            w.runs[n, k] = doubled(w.runs[0], n, k)
        return w.runs[n, k]

    def anchors(self, w: Words):
        long = w.n >= self.window
        doc = np.flatnonzero(long)
        none = np.zeros(0, dtype=np.int64)
        if not len(doc):
            return none, none, none.view(U64), none.view(U64)
        at = np.arange(len(w))
        p = at - w.first[w.doc]
        on = np.zeros(PERIOD, dtype=bool)
        on[list(COVER)] = True
        at = at[on[p % PERIOD] & long[w.doc] & (p + self.run <= w.n[w.doc])]
        doc = w.doc[at]
        p = at - w.first[doc]
        a = self._runs(w, self.run, 0)[at]
        # a hull holds at least a window of words and less than two: its first and last window make it
        lo, hi = np.maximum(0, p - self.reach), np.minimum(w.n[doc], p + self.window)
        ends = self._runs(w, self.window, 1)
        hull = mix(ends[w.first[doc] + lo] * STEP[0] + ends[w.first[doc] + hi - self.window])
        b = mix(hull + (p - lo).astype(U64) * STEP[0] + (hi - p).astype(U64))
        return doc, p, a, b

    def names(self, w: Words, doc: np.ndarray, at: np.ndarray):
        s = w.first[doc] + at
        return tuple(self._runs(w, self.window, k)[s] for k in (0, 1))

    def keep(self, w: Words, i: int, gone: np.ndarray) -> bytes:
        lo = w.first[i]
        if not gone.any():
            return w.buf[w.start[lo] : w.end[w.first[i + 1] - 1]] if w.n[i] else b""
        return b" ".join(w.buf[w.start[j] : w.end[j]] for j in (lo + np.flatnonzero(~gone)).tolist())


def dedup_substrings(docs: DataFrame, text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Documents without the words of repeated windows; see ``repeats.remove_repeats``."""
    return remove_repeats(docs, CoverSpec(window), text_col, keep)


def report(docs: DataFrame) -> DataFrame:
    """One digest row a document; see the query ``op2_substring_dedup``."""
    return dedup_substrings(docs, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_n").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
