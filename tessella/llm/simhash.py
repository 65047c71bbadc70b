"""SimHash near-duplicates: a segment-popcount grid proposes pairs, Hamming distance decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunked, connected_components, local_components, stash, texts_of, tidy, utf8

#: Words in a shingle, and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 3, 2
#: A grid cell with more distinct fingerprints than this is searched by single-bit neighbours instead.
CELL = 256
SEED = 42


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xxhash.xxh64_intdigest
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                w = Words(utf8(part.column("_text")), lower=True)
                # a document of n words has max(1, n - shingle + 1) shingles, one without words none
                per_doc = np.where(w.n > 0, np.maximum(1, w.n - shingle + 1), 0)
                lo = np.repeat(w.first[:-1] - np.cumsum(per_doc) + per_doc, per_doc) + np.arange(per_doc.sum())
                hi = np.minimum(lo + shingle, np.repeat(w.first[1:], per_doc)) - 1
                buf = w.buf
                h = np.fromiter(
                    (xx(buf[s:e], SEED) for s, e in zip(w.start[lo].tolist(), w.end[hi].tolist(), strict=True)),
                    dtype=U64,
                    count=len(lo),
                )
                out = np.zeros(part.num_rows, dtype=U64)
                full = np.flatnonzero(per_doc)
                if len(full):
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    first = (np.cumsum(per_doc) - per_doc)[full]
                    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    on = (2 * ones > per_doc[full][:, None]).astype(np.uint8)
                    out[full] = np.packbits(on, axis=1, bitorder="little").view(U64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(out.view(np.int64), pa.int64())], names=["_row", "_fp"]
                )

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the document's columns, or those of ``keep``) and its 64-bit SimHash ``_fp``; 0 for no words."""
    rows = texts_of(docs, text_col, keep=keep)
    schema = rows.select("_row", F.lit(0).cast("long").alias("_fp")).schema
    return rows.mapInArrow(tidy(_prints(shingle)), schema)


def popcounts(fp: Column) -> Column:
    """Sixteen segments of four bits, each replaced by its number of ones: a vector packed in a long."""
    ones = F.lit(0x1111111111111111)
    a, b, c, d = (F.shiftrightunsigned(fp, i).bitwiseAND(ones) if i else fp.bitwiseAND(ones) for i in range(4))
    return a + b + c + d


def cells(prints: DataFrame) -> DataFrame:
    """The grid points within Manhattan distance 1 of each popcount vector.

    A bit flip moves the vector by at most one step, so vectors of fingerprints two flips apart
    have a grid point within one step of both.
    """
    v = popcounts(F.col("_fp")) + F.lit(0x1111111111111111)  # so that a step down stays in its nibble
    steps = [F.lit(1 << 4 * i) for i in range(16)]
    near = F.array(v, *[v + s for s in steps], *[v - s for s in steps])
    return prints.select(F.explode(near).alias("cell"), "_fp")


def _links(cap: int, radius: int):
    """From rows sorted by (cell, fingerprint): a spanning set of verified links, and the crowds.

    A cell of more than ``cap`` fingerprints is passed on as rows (fingerprint, null).
    """

    def settle(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, a, b = len(cell), [], []
        at = np.arange(n)
        for d in range(1, cap):
            at = at[at + d < n]
            at = at[cell[at] == cell[at + d]]
            if not len(at):
                break
            near = np.bitwise_count((fp[at] ^ fp[at + d]).view(U64)) <= radius
            a.append(at[near])
            b.append(at[near] + d)
        if not a:
            return fp[:0], fp[:0]
        i, j = np.concatenate(a), np.concatenate(b)
        name, idx = np.unique(fp, return_inverse=True)
        root = local_components(idx[i], idx[j], len(name))
        own = np.flatnonzero(root != np.arange(len(name)))
        return name[own], name[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        cell, fp, crowd = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            c, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if crowd is not None:  # the rest of a crowded cell
                same = int(np.searchsorted(c != crowd, True)) if (c != crowd).any() else len(c)
                yield out(f[:same], pa.nulls(same, pa.int64()))
                c, f = c[same:], f[same:]
                if not len(c):
                    continue
                crowd = None
            cell, fp = np.concatenate([cell, c]), np.concatenate([fp, f])
            edge = np.flatnonzero(np.diff(cell)) + 1
            first = np.concatenate([[0], edge]).astype(np.int64)
            size = np.diff(np.concatenate([first, [len(cell)]]))
            big = np.repeat(size > cap, size)
            last_open = first[-1]
            if big.any():
                yield out(fp[big], pa.nulls(int(big.sum()), pa.int64()))
                if big[-1]:
                    crowd, last_open = int(cell[-1]), len(cell)
            done = ~big & (np.arange(len(cell)) < last_open)
            yield out(*settle(cell[done], fp[done]))
            cell, fp = cell[last_open:], fp[last_open:]
        if len(cell):
            yield out(*settle(cell, fp))

    return run


def links(prints: DataFrame, cap: int = CELL) -> DataFrame:
    """Links (u, v) that join the distinct fingerprints ``_fp`` exactly as all pairs within 2 bits would.

    Candidates share a cell of the popcount grid, and the Hamming distance of each is computed.
    Fingerprints of crowded cells meet at their single-bit neighbours: two that share one are
    within two bits, so each neighbour needs links to its smallest fingerprint only.
    """
    grid = cells(prints)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stash(
        grid.repartition(n, "cell").sortWithinPartitions("cell", "_fp").mapInArrow(tidy(_links(cap, RADIUS)), "u long, v long")
    )
    crowd = found.where("v is null").select(F.col("u").alias("_fp")).distinct()
    flips = F.array(F.col("_fp"), *[F.col("_fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    met = crowd.select(F.explode(flips).alias("mid"), "_fp")
    least = met.groupBy("mid").agg(F.min("_fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("mid", "v")
    star = met.join(least, "mid").where("_fp <> v").where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("v"))) <= RADIUS)
    return found.where("v is not null").unionByName(star.select(F.col("_fp").alias("u"), "v")).distinct()


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Every document's fingerprint and the smallest id of its component.

    Returns ``_row`` (the document's columns in a struct), ``_fp`` and ``_component``. Null and
    empty texts have fingerprint 0 and link like any other. Documents with a null id take part, but
    a component is named by its smallest id that isn't null (null if there is none).
    """
    own = stash(fingerprints(docs, text_col, keep=keep))
    return with_components(own, id_col)


def with_components(own: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``_component`` and ``_root``, a fingerprint that names the component, to stashed fingerprints."""
    least = stash(own.groupBy("_fp").agg(F.min(F.col(f"_row.`{id_col}`")).alias("_least")))
    roots = stash(connected_components(links(least.select("_fp"))))
    named = least.join(roots, least["_fp"] == roots["u"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    lowest = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    final = named.join(lowest, "_root").select("_fp", "_root", "_component")
    return own.join(final, "_fp")


def report(docs: DataFrame) -> DataFrame:
    """One row a document; see the query ``op3_simhash``."""
    return components(docs, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
