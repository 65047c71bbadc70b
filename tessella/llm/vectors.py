"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors within distance r of each other are, in at least one of B blocks of a rotation, within
r / sqrt(B). Each block is range-joined under that share of the squared distance, and the cosine of
every candidate is computed in double precision. Vectors are dealt by label and meet in the cells of
all blocks within a task, so that what is written follows the rows and not the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, stash

COSINE = 0.93
#: Blocks that the rotated dimensions are cut into; grid dimensions in each; cell width in block radii.
BLOCKS, GRID, WIDTH = 8, 2, 3.0
#: Vectors of a label that a task joins with as many others; larger labels are cut and paired piece by piece.
PIECE = 32768
#: Pairs verified at once; block distances computed at once; room for their rounding in single precision.
PAIRS, AT_ONCE, SLACK = 1 << 15, 1 << 18, 1e-5


def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix that spreads every coordinate over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Geometry:
    def __init__(self, d: int, cosine: float):
        self.turn = rotation(d)
        self.cosine = cosine
        self.edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
        # a proportional share for each block, with room for rounding
        share = np.diff(self.edges) / d
        self.budget = (2 - 2 * cosine) * share * (1 + 1e-9) + 1e-12
        self.radius = np.sqrt(self.budget)

    def unit(self, v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def cells(self, y: np.ndarray, b: int) -> np.ndarray:
        g = min(GRID, self.edges[b + 1] - self.edges[b])
        return np.floor(y[:, self.edges[b] : self.edges[b] + g] / (WIDTH * self.radius[b])).astype(np.int64)

    def block_distances(self, diff: np.ndarray) -> np.ndarray:
        return np.add.reduceat(diff * diff, self.edges[:-1], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _true(flags: np.ndarray) -> np.ndarray:
    """Where flags are set; eight are looked at together, as few are."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64))
    which, bit = np.nonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[which] * 8 + bit, whole + np.flatnonzero(flags[whole:])])


def _block_pairs(geo: Geometry, y: np.ndarray, b: int, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius of block ``b``, and some a little beyond, by the cells of its grid; each pair once.

    ``right`` marks the rows that the others are paired with; without it all are paired with all.
    """
    home = geo.cells(y, b)
    _, one_of, at = np.unique(home[:, 0] * (1 << 32) + home[:, -1], return_index=True, return_inverse=True)
    cells = home[one_of]
    width, reach = WIDTH * geo.radius[b], geo.radius[b] + 1e-9
    low = y[:, geo.edges[b] : geo.edges[b] + home.shape[1]] - home * width
    near = {-1: low <= reach, 1: width - low <= reach}  # the cell below and the one above
    part = y[:, geo.edges[b] : geo.edges[b + 1]].astype(np.float32)
    square, one = (part * part).sum(1)[:, None], np.ones((len(y), 1), dtype=np.float32)
    ours, theirs = np.hstack([-2 * part, square, one]), np.hstack([part, one, square])  # their product is the squared distance
    most = np.float32(geo.budget[b] + SLACK)
    number = {tuple(c): i for i, c in enumerate(cells.tolist())}
    members = [np.flatnonzero(at == i) for i in range(len(cells))]
    lefts, rights = (members, members) if right is None else ([m[~right[m]] for m in members], [m[right[m]] for m in members])
    size = max(AT_ONCE, max(map(len, rights)))
    room = np.empty(size, dtype=np.float32), np.empty(size, dtype=bool)
    for cell, c in number.items():
        for step in itertools.product((-1, 0, 1), repeat=home.shape[1]):
            other = number.get(tuple(x + d for x, d in zip(cell, step, strict=True)))
            if other is None or (right is None and step < (0,) * len(step)):
                continue
            l, r = lefts[c], rights[other]
            for axis, d in enumerate(step):
                if d:
                    l, r = l[near[d][l, axis]], r[near[-d][r, axis]]
            if not len(l) or not len(r):
                continue
            half = right is None and other == c
            a, z = ours[l], np.ascontiguousarray(theirs[r].T)
            rows = max(1, AT_ONCE // len(r))
            for start in range(0, len(l), rows):
                skip = start if half else 0
                shape = min(rows, len(l) - start), len(r) - skip
                d2, ok = (x[: shape[0] * shape[1]] for x in room)
                np.matmul(a[start : start + rows], z[:, skip:], out=d2.reshape(shape))
                np.less_equal(d2, most, out=ok)
                hit = _true(ok)
                i, j = l[start + hit // shape[1]], r[skip + hit % shape[1]]
                if half:
                    i, j = i[i < j], j[i < j]
                yield i, j


def _label_links(geo: Geometry, v: np.ndarray, copies: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a label, and the least one that it reaches over them."""
    u = geo.unit(v)
    y = u @ geo.turn
    n_links, root = np.zeros(len(u), dtype=np.int64), np.arange(len(u))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for b in range(len(geo.budget)):
        for i, j in _block_pairs(geo, y, b, right):
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                near = np.einsum("ij,ij->i", u[p], u[q]) >= geo.cosine
                p, q = p[near], q[near]
                # of the blocks within budget, the first counts the pair
                first = np.argmax(geo.block_distances(y[p] - y[q]) <= geo.budget, axis=1) == b
                p, q = p[first], q[first]
                np.add.at(n_links, p, copies[q])
                np.add.at(n_links, q, copies[p])
                ends.append((p, q))
                held += len(p)
                if held > 4 * AT_ONCE:  # only links that span them are held on
                    root = local_components(*(np.concatenate(e) for e in zip(*ends, strict=True)), len(u))
                    ends, held = [(np.arange(len(u)), root)], 0
    if ends:
        root = local_components(*(np.concatenate(e) for e in zip(*ends, strict=True)), len(u))
    return n_links, root


def _compare(geo: Geometry):
    """Links inside one piece of a label or between two: counts for each vector, and edges that span them."""

    def run(key, table):
        two = key[1].as_py() != key[2].as_py()
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        edges = np.flatnonzero(np.diff(label[order], prepend=label[order][0] - 1, append=label[order][-1] + 1))
        k = table.column("k").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy() == 1
        v = table.column("v").combine_chunks()
        found = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                own = order[lo:hi]
                n, root = _label_links(geo, _matrix(v.take(pa.array(own))), copies[own], side[own] if two else None)
                hit = np.flatnonzero((n > 0) | (root != np.arange(len(own))))
                found.append((k[own[hit]], n[hit], k[own[root[hit]]]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("k", "n", "root"), cols, strict=True)))

    return run


def _links_of(distinct: DataFrame, geo: Geometry) -> DataFrame:
    """Counts and spanning edges (``k``, ``n``, ``root``) of distinct vectors of one length, written.

    Small labels share buckets. Of the labels larger than a piece, at most a row for each piece, the sizes are broadcast.
    """
    sizes = distinct.groupBy("label").agg(F.count("*").alias("size"))
    buckets = max(32, -(-distinct.count() // PIECE))
    large = sizes.where(F.col("size") > PIECE).select("label", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    cut = distinct.join(F.broadcast(large), "label", "left").select(
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.col("label") + (1 << 40)).alias("bucket"),
        "label", "k", "copies", "v", F.coalesce("pieces", F.lit(1)).alias("pieces"),
        F.pmod(F.xxhash64("k", F.lit(3)), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"),
    )
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "bucket", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"),
        F.when(F.col("piece") <= F.col("other"), 0).otherwise(1).cast("int").alias("side"), "label", "k", "copies", "v",
    )
    return stash(paired.groupBy("bucket", "p", "q").applyInArrow(_compare(geo), "k long, n long, root long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links of each vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``, one row a vector.

    Only vectors of equal labels link. Vectors that are null, empty, all zero or hold null or
    non-finite components, and those with a null label, link with nothing. Each length is searched
    on its own, as only vectors of equal length link. Equal vectors are one for the search and count
    as often as they occur; rows may repeat an id.
    """
    e = F.col("embedding")
    usable = (
        e.isNotNull() & (F.size(e) > 0) & F.col("label").isNotNull()
        & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("ok"))
    lengths = sorted(r[0] for r in rows.where("ok").select(F.size("embedding")).distinct().collect())
    good = rows.where("ok")
    # -0.0 and 0.0 are one value; single precision is kept, as it takes half the room
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"
    v = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    keyed = good.select("vec_id", "label", v.alias("v")).withColumns(
        {"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(7), "v", "label")}
    )
    distinct = stash(
        keyed.groupBy("h1", "h2").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
        ).withColumn("k", F.xxhash64("h1", "h2"))
    )
    found = [_links_of(distinct.where(F.size("v") == d) if len(lengths) > 1 else distinct, Geometry(d, cosine)) for d in lengths]
    links = reduce(DataFrame.unionByName, found) if found else None
    if links is not None:
        roots = connected_components(links.where("k <> root").select(F.col("k").alias("u"), F.col("root").alias("v")))
    if links is None:
        counted = distinct.select("k", F.lit(0).cast("long").alias("n"), F.col("k").alias("root"))
    else:
        sums = links.groupBy("k").agg(F.sum("n").alias("n"))
        counted = (
            distinct.select("k").join(sums, "k", "left").join(roots.select(F.col("u").alias("k"), "root"), "k", "left")
            .select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "k").alias("root"))
        )
    whole = distinct.join(counted, "k").select("h1", "h2", "least", "copies", "n", "root")
    lowest = whole.groupBy("root").agg(F.min("least").alias("component"))
    answer = whole.join(lowest, "root").select("h1", "h2", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    linked = keyed.select("vec_id", "h1", "h2").join(answer, ["h1", "h2"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where("not ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
