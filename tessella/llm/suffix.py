"""Suffix dedup over bytes: bucket identifiers refined by those of later offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, digest, doubled, mix
from .repeats import remove_repeats

#: Bytes in a repeated string, and in the q-grams that make the initial buckets.
WINDOW, GRAM = 400, 48


class Bytes:
    """Texts one after another, with the start of each."""

    def __init__(self, texts: list[bytes | None]):
        self.n = np.array([len(t or b"") for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.buf = b"".join(t or b"" for t in texts)
        self.bytes = np.frombuffer(self.buf, dtype=np.uint8)


def sliding(pick: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def eights(x: np.ndarray) -> np.ndarray:
    """Every 8 consecutive bytes as one number."""
    if len(x) < 8:
        return np.zeros(0, dtype=U64)
    return np.lib.stride_tricks.sliding_window_view(x, 8).copy().view(U64).reshape(-1)


@dataclass(frozen=True)
class BucketSpec:
    """Suffixes in buckets of equal q-grams, refined until buckets hold equal strings of ``window`` bytes.

    Only sampled suffixes enter the initial buckets: of the q-grams in each window the one of least
    hash, so that equal windows sample the same one. Buckets of one are dropped. The suffixes of the
    open windows are then named by bucket: a bucket of 2h bytes is the pair of the bucket of h bytes
    and that at the offset h, and each round reuses the identifiers of the round before. Identifiers
    are content hashes (two of 64 bits) instead of ranks, as ranks would need one global order;
    sorting by them brings equal suffixes together.
    """

    window: int = WINDOW
    gram: int = GRAM
    #: Buckets are refined first for nodes of this many consecutive suffixes, less one.
    levels: tuple[int, ...] = (50, 7)

    @property
    def reach(self) -> int:
        return self.window - self.gram

    def units(self, texts: list[bytes | None]) -> Bytes:
        return Bytes(texts)

    def anchors(self, u: Bytes):
        none = np.zeros(0, dtype=np.int64)
        docs = np.flatnonzero(u.n >= self.window)
        if not len(docs):
            return none, none, none.view(U64), none.view(U64)
        h = doubled(eights(u.bytes), self.gram - 7, 0)  # a q-gram is as many overlapping words of 8 bytes
        start = np.zeros(len(u.bytes) + 1, dtype=np.int64)  # which positions start a window
        start[u.first[docs]] += 1
        start[u.first[docs] + u.n[docs] - self.window + 1] -= 1
        low = sliding(np.minimum, h, self.reach + 1)  # over the q-grams of a window
        low[np.cumsum(start)[: len(low)] == 0] = 0
        # a q-gram is sampled if it is the least of a window that holds it: the largest of the
        # minima over its windows is then its own hash
        padded = np.zeros(len(h) + self.reach, dtype=U64)
        padded[self.reach : self.reach + len(low)] = low
        at = np.flatnonzero(sliding(np.maximum, padded, self.reach + 1) == h)
        doc = np.searchsorted(u.first, at, side="right") - 1
        p = at - u.first[doc]
        fits = (u.n[doc] >= self.window) & (p + self.gram <= u.n[doc])
        doc, p = doc[fits], p[fits]
        base = u.first[doc]
        lo, hi = np.maximum(0, p - self.reach), np.minimum(u.n[doc], p + self.window)
        b = mix(digest(u.buf, base + lo, base + hi) + (p - lo).astype(U64) * STEP[0] + (hi - p).astype(U64))
        return doc, p, h[base + p], b

    def nodes(self, u: Bytes, doc: np.ndarray, q: np.ndarray, width: int):
        """Identifiers of what the strings at q - width to q have in common, and of all they hold."""
        base = u.first[doc]
        common = digest(u.buf, base + q, base + q - width + self.window, 1)
        lo, hi = np.maximum(0, q - width), np.minimum(u.n[doc], q + self.window)
        return common, mix(digest(u.buf, base + lo, base + hi) + (q - lo).astype(U64) * STEP[0] + (hi - q).astype(U64))

    def names(self, u: Bytes, doc: np.ndarray, at: np.ndarray):
        """Bucket identifiers of the suffixes (doc, at), refined to ``window`` bytes."""
        start = u.first[doc] + at
        # suffixes near each other share their bytes' refinement; the stretches are laid side by side
        cut = np.flatnonzero(np.append(True, np.diff(start) > self.window))
        lo, hi = start[cut], start[np.append(cut[1:], len(start)) - 1] + self.window
        size = hi - lo
        first = np.cumsum(size) - size
        pieces = u.bytes[np.repeat(lo - first, size) + np.arange(size.sum())]
        place = np.repeat(first - lo, np.diff(np.append(cut, len(start)))) + start
        return tuple(self._refine(pieces, k)[place] for k in (0, 1))

    def _refine(self, pieces: np.ndarray, k: int) -> np.ndarray:
        return doubled(mix(eights(pieces)), self.window - 7, k)

    def keep(self, u: Bytes, i: int, gone: np.ndarray) -> bytes:
        return u.bytes[u.first[i] : u.first[i + 1]][~gone].tobytes()


def dedup_suffixes(docs: DataFrame, text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Documents without the bytes of repeated strings; see ``repeats.remove_repeats``."""
    return remove_repeats(docs, BucketSpec(window), text_col, keep)


def report(docs: DataFrame) -> DataFrame:
    """One digest row a document; see the query ``op5_suffix_dedup``."""
    return dedup_suffixes(docs, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_n").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
