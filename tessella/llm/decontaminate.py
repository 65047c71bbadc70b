"""Benchmark decontamination: Wu-Manber search over words for every window of the benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, between, chunked, mix, prefix, texts_of, tidy, utf8

#: Item words in a window.
WINDOW = 13
#: Bytes of benchmark text that one pass over the documents searches for; more text takes more passes.
BLOCK_BYTES = 4 << 20
#: Lower-cases A-Z; bytes that are no digit, letter or part of a non-ASCII character become blanks.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words walked by one cursor before the next cursor's range begins.
LANE = 256


class WuManber:
    """Shift and suffix tables for patterns of one length, in words.

    A block is the last two words of a window (one for one-word patterns). ``shift`` says how far
    a window's end may move before a pattern could end there; where it is 0, the block's bucket
    lists the patterns that end in it, and their text is compared.
    """

    def __init__(self, m: int, patterns: list[bytes], items: list[list[str]]):
        self.m, self.patterns, self.items = m, patterns, items
        self.b = min(2, m)
        w = Words(patterns)
        h = w.hashes().reshape(len(patterns), m)
        self.bits = max(12, min(20, int(len(patterns) * m * 4).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.b + 1, dtype=np.int64)
        for e in range(self.b - 1, m):  # a block may end at any word of the window
            slot = self.slots(h[:, e - 1] if self.b == 2 else None, h[:, e])
            np.minimum.at(self.shift, slot, m - 1 - e)
        last = self.slots(h[:, m - 2] if self.b == 2 else None, h[:, m - 1])
        order = np.argsort(last, kind="stable")
        self.bucket_items = order
        self.bucket_first = np.searchsorted(last[order], np.arange((1 << self.bits) + 1))
        self.whole = self.window_hash(h.reshape(-1), np.arange(len(patterns)) * m)

    def slots(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        key = word if before is None else mix(before * U64(0x9E3779B97F4A7C15) + word)
        return (key >> U64(64 - self.bits)).astype(np.int64)

    def window_hash(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return between(prefix(h, 1), at, at + self.m, 1)

    def search(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(index of the first word, pattern) of every occurrence inside one document."""
        m, n = self.m, len(w)
        if n < m:
            return
        before = None
        if self.b == 2:
            before = np.concatenate([h[:1], h[:-1]])
        slot = self.slots(before, h)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = self.shift[slot[at]]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        end = np.sort(np.concatenate(found))
        end = end[w.doc[end] == w.doc[end - m + 1]]
        lo, hi = self.bucket_first[slot[end]], self.bucket_first[slot[end] + 1]
        size = hi - lo
        who = np.repeat(end, size)
        off = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        pat = self.bucket_items[np.repeat(lo, size) + off]
        if not len(who):
            return
        same = self.window_hash(h, who - m + 1) == self.whole[pat]
        for e, p in zip(who[same].tolist(), pat[same].tolist(), strict=True):
            s = e - m + 1
            if w.buf[w.start[s] : w.end[e]] == self.patterns[p]:
                yield s, p


def matchers(rows: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """Tables for the windows of items (id, text), one set for each pattern length."""
    by_len: dict[int, dict[bytes, set[str]]] = {}
    for item, text in rows:
        words = (text or "").encode().translate(TABLE).split()
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            by_len.setdefault(k, {}).setdefault(b" ".join(words[i : i + k]), set()).add(item)
    return [WuManber(k, list(p), [sorted(x) for x in p.values()]) for k, p in sorted(by_len.items())]


def _pass(tables) -> object:
    """One pass over the documents for one block of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = tables.value
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                col = {n: part.column(n) for n in part.schema.names}
                w = Words(utf8(col["_text"]), TABLE)
                n_docs = part.num_rows
                items = [set(x or ()) for x in col["_items"].to_pylist()]
                hit = np.zeros(len(w) + 1, dtype=np.int64)
                for i, bits in enumerate(col["_hits"].to_pylist()):
                    if bits:
                        on = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=int(w.n[i]))
                        for at in np.flatnonzero(on):
                            hit[w.first[i] + at] += 1
                            hit[w.first[i] + at + 1] -= 1
                h = w.hashes() if len(w) else np.zeros(0, dtype=U64)
                for t in found_by:
                    for s, p in t.search(w, h):
                        hit[s] += 1
                        hit[s + t.m] -= 1
                        items[w.doc[s]].update(t.items[p])
                on = np.cumsum(hit[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(on)])
                count = total[w.first[1:]] - total[w.first[:-1]]
                bits = [
                    np.packbits(on[w.first[i] : w.first[i + 1]]).tobytes() if count[i] else None for i in range(n_docs)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        col["_row"],
                        col["_text"],
                        pa.array(w.n, pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array(bits, pa.binary()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=["_row", "_text", "_n_words", "_n_hit", "_hits", "_items"],
                )

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document with its words that lie in an occurrence of a benchmark window.

    Returns ``_row`` (a struct of the document's columns, or those of ``keep``, whatever their names), ``_n_words``,
    ``_n_hit``, ``_hits`` (a bitmap over the words, null where none is hit) and ``_items`` (sorted
    ids of the items found, as strings). Null and empty texts have no words. Items with a null id
    or without words are never found; repeated items count once. The benchmark is read in blocks of
    ``block_bytes``, one pass each, so that no broadcast grows with it; the documents aren't shuffled.
    """
    spark = docs.sparkSession
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("x"))
    total = bench.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    schema_row = texts_of(docs, text_col, keep=keep)
    out = schema_row.withColumns(
        {
            "_n_words": F.lit(0).cast("long"),
            "_n_hit": F.lit(0).cast("long"),
            "_hits": F.lit(None).cast("binary"),
            "_items": F.array().cast("array<string>"),
        }
    )
    for b in range(n_blocks):
        block = bench.where(F.pmod(F.xxhash64("i", "x"), F.lit(n_blocks)) == b) if n_blocks > 1 else bench
        tables = spark.sparkContext.broadcast(matchers([tuple(r) for r in block.collect()], window))
        out = out.mapInArrow(tidy(_pass(tables)), out.schema)
    return out.select("_row", "_n_words", "_n_hit", "_hits", "_items")


def contaminated() -> F.Column:
    """The contract's rule: at least a twentieth of the words is hit."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One digest row a document; see the query ``op1_decontaminate``."""
    found = decontaminate(docs, benchmark, keep=["doc_id"])
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )

