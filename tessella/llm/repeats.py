"""Exact removal of long repeated passages, whatever the unit (words or bytes).

A repeat is a window of fixed length whose content also starts elsewhere. Three sorted shuffles find
all of them without comparing pairs:

1. Anchors: a few positions of each document, chosen by content or offset so that two equal windows
   have an equal anchor at the same place inside. Anchors are sorted by (anchor hash, hull hash),
   the hull being the stretch that holds every window with that anchor. Equal hulls prove all their
   windows repeated; an anchor alone with its hash is dropped; what differs in the hull is open.
2. Where a hull holds many windows, the open ones are cut into nodes of fewer consecutive windows,
   sorted by (hash of what the node's windows have in common, hash of the node's hull) and settled
   the same way: a node alone with its common part has no repeat, an equal hull proves the node.
3. Windows still open (and those of one hull of each repeated kind, as partners) are named and
   sorted by name; a name that comes twice is a repeat.
4. Marks are gathered by document and merged to intervals.

Each sort is Spark's own, so it spills; the Python side walks sorted rows and keeps little. What
repeats inside a chunk of documents is settled there, so that frequent content sends one row a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bucketed, chunked, doc_key, mix, stash, texts_of, utf8

#: Rows of one anchor that are held at once; more of them are settled in parts.
GROUP_ROWS = 1 << 17
HULL, OPEN = 1, 2
#: Bytes of the positions of all documents with repeats, up to which they are broadcast to the texts.
FEW = BROADCAST_BYTES
#: What a chunk knows of its rows, beside 1 for several equal ones.
MIXED, SETTLED = 4, 16


def _first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size): rows sorted by keys, starts of runs of equal keys, their sizes."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _record(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"p": pa.int32(), "s": pa.int8()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64) if n not in kinds else c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)],
        names=names,
    )


ROW = ["a", "b", "_id", "_t", "p", "s"]
ROW_DDL = "a long, b long, _id long, _t long, p int, s byte"


def _emit(a: np.ndarray, b: np.ndarray, ids: np.ndarray, ts: np.ndarray, p: np.ndarray, mixed: bool = True) -> pa.RecordBatch:
    """Rows for the sort, of which s tells what the chunk itself shows.

    Of equal (a, b) one row goes on, with s = 1 if the chunk has several; where ``mixed``, also of
    equal a only one goes on, with MIXED added. The others are settled here: s is SETTLED plus the
    outcome that the sort would give them, and their key is scattered. So a key that a large share
    of all documents has sends one row a chunk.
    """
    a, b = a.view(np.int64), b.view(np.int64)
    order, first, size = _first_of_equal(a, b)
    a, b, ids, ts, p = a[order], b[order], ids[order], ts[order], p[order]
    s = np.full(len(order), SETTLED + HULL, dtype=np.int8)
    s[first] = size > 1
    if mixed and len(order):
        kind_a = a[first]
        new = np.append(True, kind_a[1:] != kind_a[:-1])
        at = np.flatnonzero(new)
        several = np.diff(np.append(at, len(first))) > 1  # an anchor hash with several hulls
        s[first[at[several]]] += MIXED
        rest = first[~new]
        s[rest] = SETTLED + OPEN + HULL * (size[~new] > 1)
    done = s >= SETTLED
    a = np.where(done, mix(a.view(np.uint64) + p.astype(np.uint64) + ids.view(np.uint64)).view(np.int64), a)
    return _record(ROW, a, b, ids, ts, p.astype(np.int32), s)


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in chunked(batch, batch.schema.get_field_index("_text")):
            ids, ts = (part.column(k).to_numpy(zero_copy_only=False) for k in ("_id", "_t"))
            yield part, utf8(part.column("_text")), ids, ts


def _anchor_rows(spec) -> Callable:
    def run(batches):
        for _, texts, ids, ts in _docs(batches):
            doc, p, a, b = spec.anchors(spec.units(texts))
            if len(p):
                yield _emit(a, b, ids[doc], ts[doc], p)

    return run


def _walk(batches: Iterator[pa.RecordBatch], settle: Callable) -> Iterator[pa.RecordBatch]:
    """Calls settle(columns, part) on whole groups of rows with equal ``a``; part: of an oversized group."""
    held: list[np.ndarray] | None = None
    parted: int | None = None  # the group of which parts have been settled
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ROW]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        a = cols[0]
        cut = int(np.searchsorted(a, a[-1]))  # sorted: the last group may go on
        if parted is not None and cut and a[0] == parted:
            end = int(np.searchsorted(a, parted, side="right"))
            yield from settle([c[:end] for c in cols], True)
            cols, a, cut, parted = [c[end:] for c in cols], a[end:], cut - end, None
        elif parted is not None and a[0] != parted:
            parted = None
        if cut:
            yield from settle([c[:cut] for c in cols], False)
        held = [c[cut:] for c in cols]
        if len(held[0]) > GROUP_ROWS:
            yield from settle(held, True)
            parted, held = int(held[0][-1]), None
    if held is not None:
        yield from settle(held, parted is not None and held[0][0] == parted)


def _settle_anchors(cols: list[np.ndarray], part: bool) -> Iterator[pa.RecordBatch]:
    a, b, ids, ts, p, s = cols
    known = s >= SETTLED
    if known.any():
        yield _record(ROW[2:], ids[known], ts[known], p[known], s[known] - np.int8(SETTLED))
        a, b, ids, ts, p, s = (c[~known] for c in cols)
    if not len(a):
        return
    new_a = np.append(True, a[1:] != a[:-1])
    new_b = new_a | np.append(True, b[1:] != b[:-1])
    kind = np.cumsum(new_b) - 1
    group = np.cumsum(new_a) - 1
    many = (np.bincount(kind, minlength=kind[-1] + 1) > 1) | (np.bincount(kind, weights=s & 1, minlength=kind[-1] + 1) > 0)
    mixed = (np.bincount(group[new_b], minlength=group[-1] + 1) > 1) | (np.bincount(group, weights=s & MIXED, minlength=group[-1] + 1) > 0) | part
    out = np.where(many[kind], HULL, 0) + np.where(mixed[group] & (new_b | ~many[kind]), OPEN, 0)
    keep = out > 0
    yield _record(ROW[2:], ids[keep], ts[keep], p[keep], out[keep].astype(np.int8))


def _settle_windows(cols: list[np.ndarray], part: bool) -> Iterator[pa.RecordBatch]:
    a, b, ids, ts, p, s = cols
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    kind = np.cumsum(new) - 1
    many = (np.bincount(kind) > 1) | (np.bincount(kind, weights=s) > 0) | part  # s > 0: several in a chunk
    keep = many[kind]
    yield _record(ROW[2:], ids[keep], ts[keep], p[keep], np.full(int(keep.sum()), HULL, dtype=np.int8))


def _sorted_walk(rows: DataFrame, settle: Callable, n: int) -> DataFrame:
    def run(batches):
        yield from _walk(batches, settle)

    return rows.repartition(n, "a").sortWithinPartitions("a", "b").mapInArrow(run, "_id long, _t long, p int, s byte")


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """Flat list of the merged intervals; ``lo`` ascends."""
    if not len(lo):
        return []
    top = np.maximum.accumulate(hi)
    at = np.flatnonzero(np.append(True, lo[1:] > top[:-1] + 1))
    return np.column_stack([lo[at], top[np.append(at[1:] - 1, len(lo) - 1)]]).reshape(-1).tolist()


def _per_document(batches: Iterator[pa.RecordBatch], make: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Calls make(columns) for the rows of each document; rows come sorted by (_id, _t)."""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * (len(names) - 2)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.flatnonzero(np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)))
        out = [make(*(c[i:j] for c in cols)) for i, j in zip(new[:-1], new[1:], strict=True)]
        if out:
            yield packed(out)
        held = [c[new[-1] :] for c in cols]
    if held is not None:
        yield packed([make(*held)])


def _tops(width: int) -> Callable:
    """From a document's anchors or nodes in order: intervals of proven window starts, and the open ones.

    An anchor or node at p stands for the window starts from p - width to p.
    """

    def document(ids, ts, p, s):
        m = (s & HULL) > 0
        return int(ids[0]), int(ts[0]), _merged(np.maximum(0, p[m] - width), p[m]), np.unique(p[(s & OPEN) > 0]).tolist()

    def run(batches):
        yield from _per_document(batches, document, ["_id", "_t", "marks", "open"])

    return run


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def document(ids, ts, lo, hi):
        return int(ids[0]), int(ts[0]), _merged(lo, hi)

    yield from _per_document(batches, document, ["_id", "_t", "marks"])


def _by_document(rows: DataFrame, width: int, n: int) -> DataFrame:
    return (
        rows.repartition(n, "_id", "_t").sortWithinPartitions("_id", "_t", "p")
        .mapInArrow(_tops(width), "_id long, _t long, marks array<int>, open array<int>")
    )


def _node_rows(spec, before: int, width: int) -> Callable:
    """Rows of the nodes of ``width`` + 1 windows that the open nodes of ``before`` + 1 are cut into."""

    def run(batches):
        for part, texts, ids, ts in _docs(batches):
            units = spec.units(texts)
            doc, at = [], []
            for i, tops in enumerate(part.column("open").to_pylist()):
                q = np.unique((np.array(tops)[:, None] - np.arange(0, before + 1, width + 1)[None, :]).reshape(-1))
                q = q[(q >= 0) & (np.maximum(q - width, 0) <= units.n[i] - spec.window)]
                doc.append(np.full(len(q), i))
                at.append(q)
            doc, at = np.concatenate(doc), np.concatenate(at)
            if len(at):
                yield _emit(*spec.nodes(units, doc, at, width), ids[doc], ts[doc], at)

    return run


def _window_rows(spec, width: int) -> Callable:
    def run(batches):
        for part, texts, ids, ts in _docs(batches):
            units = spec.units(texts)
            doc, at = [], []
            for i, tops in enumerate(part.column("open").to_pylist()):
                r = np.unique((np.array(tops)[:, None] - np.arange(width + 1)[None, :]).reshape(-1))
                r = r[(r >= 0) & (r <= units.n[i] - spec.window)]
                doc.append(np.full(len(r), i))
                at.append(r)
            doc, at = np.concatenate(doc), np.concatenate(at)
            if len(at):
                yield _emit(*spec.names(units, doc, at), ids[doc], ts[doc], at, mixed=False)

    return run


def _cut(spec) -> Callable:
    def run(batches):
        for part, texts, _, _ in _docs(batches):
            units = spec.units(texts)
            kept, n_gone, n_runs = [], [], []
            for i, flat in enumerate(part.column("marks").to_pylist()):
                n = int(units.n[i])
                gone = np.zeros(n + 1, dtype=np.int64)
                for lo, hi in zip((flat or [])[::2], (flat or [])[1::2], strict=True):
                    hi = min(hi, n - spec.window)
                    if hi >= lo:
                        gone[lo] += 1
                        gone[hi + spec.window] -= 1
                out = np.cumsum(gone[:-1]) > 0
                kept.append(spec.keep(units, i, out))
                n_gone.append(int(out.sum()))
                n_runs.append(int(np.count_nonzero(np.diff(np.append(0, out.astype(np.int8))) == 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    pa.array(kept, pa.binary()),
                    pa.array(units.n, pa.int64()),
                    pa.array(n_gone, pa.int64()),
                    pa.array(n_runs, pa.int64()),
                ],
                names=["_row", "_kept", "_n", "_n_removed", "_n_spans"],
            )

    return run


def keyed(docs: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    return texts_of(docs, text_col, *doc_key("doc_id", text_col), keep=keep)


def remove_repeats(docs: DataFrame, spec, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents without the units that a repeated window covers.

    Returns ``_row`` (struct of the document's columns, or those of ``keep``), ``_kept`` (binary), ``_n`` (units),
    ``_n_removed`` and ``_n_spans`` (maximal runs removed). Null texts count as empty. Rows that
    repeat id and text are separate documents, so each is a repeat of the other. Texts are read
    again for each step; between the steps only positions are kept. They are broadcast where their
    summed bytes are at most ``FEW``; else the texts are dealt once into buckets of their documents,
    and each step moves positions only.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, text_col, keep)
    anchors = texts.drop("_row").where("_text is not null").mapInArrow(_anchor_rows(spec), ROW_DDL)
    width = spec.reach
    steps = [stash(_by_document(_sorted_walk(anchors, _settle_anchors, n), width, n))]
    dealt: list[DataFrame] = []

    def met(side: DataFrame, how: str) -> DataFrame:
        """Texts with what is known of their documents: positions travel, texts stay where they are."""
        held = sum((F.size(c) for c in side.columns[2:]), F.lit(0))
        if (side.agg(F.sum(32 + 4 * held)).first()[0] or 0) <= FEW:
            return (dealt[0] if dealt else texts).join(F.broadcast(side), ["_id", "_t"], how)
        if not dealt:
            dealt.append(bucketed(texts, ["_id", "_t"], n))
        return dealt[0].join(side.hint("shuffle_hash"), ["_id", "_t"], how)

    def opened(found: DataFrame) -> DataFrame:
        todo = found.where(F.size("open") > 0).select("_id", "_t", "open")
        return met(todo, "inner").select("_id", "_t", "_text", "open")

    for narrower in spec.levels:
        nodes = opened(steps[-1]).mapInArrow(_node_rows(spec, width, narrower), ROW_DDL)
        width = narrower
        steps.append(stash(_by_document(_sorted_walk(nodes, _settle_anchors, n), width, n)))
    again = _sorted_walk(opened(steps[-1]).mapInArrow(_window_rows(spec, width), ROW_DDL), _settle_windows, n)
    found = again.select("_id", "_t", F.col("p").alias("lo"), F.col("p").alias("hi"))
    pair = "transform(sequence(0, size(marks) div 2 - 1), i -> struct(marks[2*i] as lo, marks[2*i+1] as hi))"
    for step in steps:
        proven = step.where(F.size("marks") > 0).select("_id", "_t", F.explode(F.expr(pair)).alias("r"))
        found = found.unionByName(proven.select("_id", "_t", "r.lo", "r.hi"))
    marks = stash(
        found.repartition(n, "_id", "_t").sortWithinPartitions("_id", "_t", "lo")
        .mapInArrow(_merge_marks, "_id long, _t long, marks array<int>")
    )
    joined = met(marks, "left").select("_row", "_id", "_t", "_text", "marks")
    out = joined.select("_row", F.lit(b"").alias("_kept"), *[F.lit(0).cast("long").alias(c) for c in ("_n", "_n_removed", "_n_spans")])
    return joined.mapInArrow(_cut(spec), out.schema)
