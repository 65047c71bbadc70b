"""Masks and components: thresholds, availability, labelling, holes, isolation, pairing, clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, dice, iou, lit
from ..lineage import written
from .raster import KEY, disk, erode, otsu


def threshold_mask(pixels: DataFrame, mode: str = "percentile", percentile: float = 45, fixed: int = 18, offset: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """Foreground ``fg`` where v exceeds the image's threshold.

    Modes: "percentile" (of the non-zero pixels, truncated), "fixed", "otsu" (plus ``offset``, cut to 0..255).
    """
    if mode == "fixed":
        return pixels.withColumn("fg", (F.col("v") > fixed).cast("int"))
    if mode == "percentile":
        t = pixels.where("v > 0").groupBy(*key).agg(F.percentile("v", percentile / 100).cast("int").alias("threshold"))
    elif mode == "otsu":
        t = otsu(pixels, key).withColumn("threshold", clamp(F.col("threshold") + offset, 0, 255))
    else:
        raise ValueError("mode must be percentile, fixed or otsu")
    joined = pixels.join(t, list(key), "left")
    return joined.withColumn("fg", F.coalesce((F.col("v") > F.col("threshold")).cast("int"), F.lit(0))).drop("threshold")


def dense_pixels(pixels: DataFrame, p: float = 40, key: Sequence[str] = KEY) -> DataFrame:
    """Of the tissue pixels (fg), those at or above the p-th percentile of their density v."""
    tissue = pixels.where("fg = 1")
    limit = tissue.groupBy(*key).agg(F.percentile("v", p / 100).alias("limit"))
    return tissue.join(limit, list(key)).where("v >= limit").drop("limit")


def valid_and_dense(pixels: DataFrame, p: float = 40, seam: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """Dense tissue whose neighbourhood holds no void pixel (v = 0)."""
    solid = erode(pixels.withColumn("v", (F.col("v") > 0).cast("int")).select(*key, "y", "x", "v"), disk(seam), key)
    return dense_pixels(pixels, p, key).join(solid.where("v = 1").select(*key, "y", "x"), [*key, "y", "x"], "left_semi")


def available(mask: DataFrame, radius: int, h: int, w: int, key: Sequence[str] = KEY) -> DataFrame:
    """Foreground pixels with only foreground around them and not nearer to the edge than the radius."""
    r = F.col("x").between(radius, w - radius - 1) & F.col("y").between(radius, h - radius - 1)
    keep = erode(mask.select(*key, "y", "x", F.col("fg").alias("v")), disk(radius), key)
    return keep.where("v = 1").where(r).select(*key, "y", "x")


def available_boundary(mask: DataFrame, radius: int, h: int, w: int) -> DataFrame:
    return mask.where("fg = 1").where(F.col("x").between(radius, w - radius - 1) & F.col("y").between(radius, h - radius - 1))


def stored_availability(free: DataFrame, grid: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """As written to disk: 0 where available, 255 elsewhere."""
    flags = free.select(*key, "y", "x", F.lit(0).alias("a"))
    return grid.select(*key, "y", "x").join(flags, [*key, "y", "x"], "left").select(*key, "y", "x", F.coalesce("a", F.lit(255)).alias("v"))


# --- kernels on one image, run image by image on the executors ---


def label_image(fg: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Components of a mask, numbered from 1 in scan order; union-find over runs of pixels."""
    lab = np.zeros(fg.shape, dtype=np.int32)
    parent = [0]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if connectivity == 8 else 0
    before: list[tuple[int, int, int]] = []
    for y in range(fg.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], fg[y].astype(np.int8), [0]])))
        runs = []
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            own = 0
            for a, b, k in before:
                if a < hi + reach and b > lo - reach:
                    k = root(k)
                    if own and own != k:
                        parent[max(own, k)] = min(own, k)
                        own = min(own, k)
                    else:
                        own = k
            if not own:
                own = len(parent)
                parent.append(own)
            lab[y, lo:hi] = own
            runs.append((lo, hi, own))
        before = runs
    names = np.array([root(i) for i in range(len(parent))])
    _, order = np.unique(names, return_inverse=True)
    return order.astype(np.int32)[lab]


def chamfer(fg: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest background pixel (exact), by columns and then rows."""
    h, w = fg.shape
    big = float((h + w) ** 2)
    d = np.where(fg, big, 0.0)
    col = np.zeros((h, w))
    run = np.full(w, np.inf)
    for y in range(h):
        run = np.where(d[y] == 0, 0, run + 1)
        col[y] = run
    run = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        run = np.where(d[y] == 0, 0, run + 1)
        col[y] = np.minimum(col[y], run)
    sq = np.minimum(col, h + w) ** 2
    # along the rows, columns further away are looked at only while they can be nearer
    best = sq.copy()
    for dx in range(1, w):
        if dx * dx >= best.max():
            break
        np.minimum(best[:, dx:], sq[:, :-dx] + dx * dx, out=best[:, dx:])
        np.minimum(best[:, :-dx], sq[:, dx:] + dx * dx, out=best[:, :-dx])
    return np.sqrt(best)


def fill_holes_image(fg: np.ndarray, max_share: float = 0.005, max_fg_share: float = 0.05, max_radius: float = 6.0) -> np.ndarray:
    """Fill background parts that don't touch the edge, are small and narrow enough."""
    lab = label_image(~fg, 4)
    limit = max(max_share * fg.size, max_fg_share * fg.sum())
    out = fg.copy()
    for k, (rows, cols) in enumerate(label_boxes(lab), 1):
        if rows.start == 0 or cols.start == 0 or rows.stop == fg.shape[0] or cols.stop == fg.shape[1]:
            continue
        part = lab[rows, cols] == k
        if part.sum() <= limit and chamfer(np.pad(part, 1)).max() <= max_radius:
            out[rows, cols] |= part
    return out


def label_boxes(lab: np.ndarray) -> list[tuple[slice, slice]]:
    """The box of each label from 1 on."""
    y, x = np.nonzero(lab)
    n = int(lab.max(initial=0)) + 1
    lo, hi = np.full((2, n), max(lab.shape)), np.zeros((2, n), dtype=int)
    for i, c in enumerate((y, x)):
        np.minimum.at(lo[i], lab[y, x], c)
        np.maximum.at(hi[i], lab[y, x], c + 1)
    return [(slice(lo[0, k], hi[0, k]), slice(lo[1, k], hi[1, k])) for k in range(1, n)]


def small_removed(fg: np.ndarray, min_area: int, connectivity: int = 8) -> np.ndarray:
    lab = label_image(fg, connectivity)
    area = np.bincount(lab.reshape(-1))
    area[0] = 0
    return area[lab] >= max(1, min_area)


def _shift_max(a: np.ndarray, r: int) -> np.ndarray:
    out = np.zeros_like(a)
    h, w = a.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r + 1e-9:
                out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] |= a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def watershed_image(fg: np.ndarray, min_area: int = 30, dist_share: float = 0.45, peak_dist: int = 1) -> np.ndarray:
    """Split touching objects: seeds far from the edge, flooded by falling distance."""
    import heapq

    fg = small_removed(fg, min_area)
    if not fg.any():
        return np.zeros(fg.shape, dtype=np.int32)
    dist = chamfer(fg)
    seeds = dist / dist.max() > dist_share
    if peak_dist:
        seeds = ~_shift_max(~seeds, peak_dist) if peak_dist > 1 else seeds
    lab = label_image(seeds, 8)
    queue = [(-dist[y, x], int(y), int(x)) for y, x in np.argwhere(lab > 0)]
    heapq.heapify(queue)
    while queue:
        _, y, x = heapq.heappop(queue)
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            a, b = y + dy, x + dx
            if 0 <= a < fg.shape[0] and 0 <= b < fg.shape[1] and fg[a, b] and not lab[a, b]:
                lab[a, b] = lab[y, x]
                heapq.heappush(queue, (-dist[a, b], a, b))
    area = np.bincount(lab.reshape(-1))
    lab[(area < min_area)[lab]] = 0
    return np.unique(lab, return_inverse=True)[1].reshape(lab.shape).astype(np.int32)


def per_image(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str, key: Sequence[str] = KEY, value: str = "fg", keep: Callable | None = None) -> DataFrame:
    """Run an array kernel on each image; a task holds one image at a time."""
    names = list(key)
    fields = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    ddl = ", ".join([f"{k} {fields[k]}" for k in names] + ["y int", "x int", f"{out} int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(dtype=int), pdf["x"].to_numpy(dtype=int)
        a = np.zeros((y.max() + 1, x.max() + 1), dtype=float)
        a[y, x] = pdf[value]
        got = kernel(a)
        return pdf[names].assign(y=y.astype("int32"), x=x.astype("int32"), **{out: np.asarray(got)[y, x].astype("int32")})

    return pixels.groupBy(*key).applyInPandas(run, ddl)


def components(mask: DataFrame, connectivity: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    """Labels of the foreground, 0 for background."""
    return per_image(mask, lambda a: label_image(a > 0, connectivity), "label", key)


def component_stats(labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Area, centroid and box of every component."""
    return labels.where("label > 0").groupBy(*key, "label").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
    )


def large_components(labels: DataFrame, min_area: int, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels of components of at least ``min_area``."""
    big = labels.where("label > 0").groupBy(*key, "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_area)
    return labels.join(big.select(*key, "label"), [*key, "label"], "left_semi")


def row_runs(mask: DataFrame, width: int, key: Sequence[str] = KEY) -> DataFrame:
    """Foreground runs of rows as components: label is the run's first pixel, counted from 1 in rows of ``width``."""
    row = Window.partitionBy(*key, "y").orderBy("x")
    first = F.col("x") - F.row_number().over(row)
    runs = mask.where("fg = 1").withColumn("_g", first)
    start = F.min("x").over(Window.partitionBy(*key, "y", "_g"))
    return runs.withColumn("label", F.col("y").cast("long") * width + start + 1).drop("_g")


def isolated(stats: DataFrame, h: int, w: int, min_area: int = 10, k: float = 1.5, key: Sequence[str] = KEY) -> DataFrame:
    """Components with centroid in the central two thirds and area up to Q3 + k IQR of those."""
    central = F.col("cx").between(w / 6, 5 * w / 6) & F.col("cy").between(h / 6, 5 * h / 6)
    some = stats.where((F.col("area") >= min_area) & central)
    q = some.groupBy(*key).agg(F.percentile("area", F.array(lit(0.25), lit(0.75))).alias("q"))
    top = F.col("q")[1] + lit(k) * (F.col("q")[1] - F.col("q")[0])
    return some.join(q, list(key)).where(F.col("area") <= top).drop("q")


def touching(labels: DataFrame, radius: int, key: Sequence[str] = KEY) -> DataFrame:
    """Components with a pixel of another one within the radius; found by sending each pixel to its disk."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx, _ in disk(radius)])
    own = labels.where("label > 0").select(*key, "label", "y", "x")
    sent = own.withColumn("o", F.explode(offsets)).select(*key, F.col("label").alias("other"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return own.join(sent, [*key, "y", "x"]).where("label <> other").select(*key, "label").distinct()


def overlap_pairs(a: DataFrame, b: DataFrame, min_cover: float = 0.4, key: Sequence[str] = KEY) -> DataFrame:
    """Pairs of components that share pixels, with coverages and F1.

    The theta join on boxes is an equi-join on pixels, whose counts combine before the shuffle.
    Both sides carry ``label`` and pixel rows.
    """
    la, lb = (s.where("label > 0").select(*key, "y", "x", F.col("label").alias(n)) for s, n in ((a, "a"), (b, "b")))
    both = la.join(lb, [*key, "y", "x"]).groupBy(*key, "a", "b").agg(F.count("*").alias("inter"))
    aa = la.groupBy(*key, "a").agg(F.count("*").alias("area_a"))
    ab = lb.groupBy(*key, "b").agg(F.count("*").alias("area_b"))
    full = both.join(aa, [*key, "a"]).join(ab, [*key, "b"])
    full = full.withColumns({"cov_a": F.col("inter") / (F.col("area_a") + lit(1e-6)), "cov_b": F.col("inter") / (F.col("area_b") + lit(1e-6))})
    f1 = 2 * F.col("cov_a") * F.col("cov_b") / (F.col("cov_a") + F.col("cov_b") + lit(1e-6))
    return full.withColumn("f1", f1).where(F.least("cov_a", "cov_b") >= min_cover)


def pair_funnel(a: DataFrame, b: DataFrame, min_cover: float = 0.4, key: Sequence[str] = KEY) -> DataFrame:
    """How many component pairs there are, overlap in pixels, and cover enough."""
    def count(side):
        return side.where("label > 0").groupBy(*key).agg(F.countDistinct("label").alias("n"))

    total = count(a).join(count(b).withColumnRenamed("n", "m"), list(key)).select(*key, (F.col("n") * F.col("m")).alias("n_total"))
    met = overlap_pairs(a, b, 0.0, key).groupBy(*key).agg(F.count("*").alias("n_inter"), F.count_if(F.least("cov_a", "cov_b") >= min_cover).alias("n_sym"))
    return total.join(met, list(key), "left").select(*key, "n_total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_inter", "n_sym")))


def top_pairs(pairs: DataFrame, k: int = 3, key: Sequence[str] = KEY) -> DataFrame:
    """The k best pairs per tile; a component may be in several."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("f1", 9)), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mask_scores(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Dice and IoU of two masks on the same grid."""
    joined = a.select(*key, "y", "x", F.col("fg").alias("a")).join(b.select(*key, "y", "x", F.col("fg").alias("b")), [*key, "y", "x"], "full_outer")
    s = joined.groupBy(*key).agg(F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0))).alias("ab"), F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"))
    return s.select(*key, dice(F.col("ab"), F.col("na"), F.col("nb")).alias("dice"), iou(F.col("ab"), F.col("na"), F.col("nb")).alias("iou"))


def clusters(stats: DataFrame, eps: float = 50.0, key: Sequence[str] = KEY, rounds: int = 40) -> DataFrame:
    """Component clusters: centroids within eps are linked, links are transitive.

    Neighbours come from a grid of width eps; clusters then join the lowest one that they touch,
    with pointer jumping, until nothing changes. Each round is written, so lineage stays short.
    """
    own = stats.select(*key, "label", "cx", "cy", "area")
    pairs = close_pairs(own.withColumnsRenamed({"cx": "x", "cy": "y", "label": "pid"}).select(*key, "pid", "x", "y"), eps, key)
    both = pairs.select(*key, F.col("i").alias("u"), F.col("j").alias("v"))
    both = both.unionByName(both.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both)
    names = own.select(*key, "label", F.col("label").alias("cluster"))
    for _ in range(rounds):
        near = both.join(names.select(*key, F.col("label").alias("v"), "cluster"), [*key, "v"]).groupBy(*key, F.col("u").alias("label")).agg(F.min("cluster").alias("low"))
        step = names.join(near, [*key, "label"], "left").withColumn("low", F.coalesce("low", "cluster"))
        # a whole cluster moves to the lowest that any of its members touches, and on to where that one moves
        hook = written(step.groupBy(*key, "cluster").agg(F.min("low").alias("low")).select(*key, "cluster", F.least("cluster", "low").alias("next")))
        on = hook.select(*key, F.col("cluster").alias("next"), F.col("next").alias("after"))
        hook = hook.join(on, [*key, "next"]).select(*key, "cluster", "after")
        step = names.join(hook, [*key, "cluster"]).select(*key, "label", F.col("after").alias("cluster"), (F.col("after") < F.col("cluster")).alias("moved"))
        step = written(step)
        moved = step.where("moved").limit(1).count()
        names = step.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"clusters aren't settled after {rounds} rounds")
    return own.join(names, [*key, "label"])


def top_clusters(clustered: DataFrame, k: int = 15, min_area: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """The k largest clusters per image by summed area."""
    area = clustered.groupBy(*key, "cluster").agg(F.sum("area").alias("area")).where(F.col("area") >= min_area)
    order = Window.partitionBy(*key).orderBy(F.desc("area"), "cluster")
    return area.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def finite(points: DataFrame) -> DataFrame:
    """Points with both coordinates; those without are close to nothing."""
    return points.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy"))


def close_pairs(points: DataFrame, r: float, key: Sequence[str] = ()) -> DataFrame:
    """Pairs i < j of points at most r apart, by a grid of width r: each point meets its cell and four of those around it.

    Neither side is broadcast, as the spread one has five times the rows that Spark estimates.
    """
    cell = {"_gx": F.floor(F.col("x") / lit(r)), "_gy": F.floor(F.col("y") / lit(r))}
    p = finite(points).where("pid is not null").withColumns(cell)
    a = p.select(*key, F.col("pid").alias("_p"), F.col("x").alias("ax"), F.col("y").alias("ay"), "_gx", "_gy")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    b = p.withColumn("_o", F.explode(steps)).select(
        *key, F.col("pid").alias("_q"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("_gx") + F.col("_o.dx")).alias("_gx"),
        (F.col("_gy") + F.col("_o.dy")).alias("_gy"), ((F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)).alias("_own"),
    )
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    met = a.join(b.hint("merge"), [*key, "_gx", "_gy"]).where(F.when(F.col("_own"), F.col("_p") < F.col("_q")).otherwise(F.col("_p") != F.col("_q")))
    return met.withColumn("d2", d2).where(F.col("d2") <= r * r).select(*key, F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), "d2")


#: Points of a tile whose neighbours a task counts together; the points that a tile should hold.
OWN, TILE = 65536, 4096


def _near_counts(x: np.ndarray, y: np.ndarray, own: np.ndarray, pid: np.ndarray, r: float) -> np.ndarray:
    """How many of the points are at most r from each of the own ones and have another id.

    Whole cells of a fine grid that lie within r are counted at once; only points of cells on the rim are measured.
    """
    n = np.zeros(len(own), dtype=np.int64)
    spread = max((x.max() - x.min()) * (y.max() - y.min()), r * r)
    fine = int(np.clip(np.sqrt(len(x) * r * r / spread / 24), 1, 32))
    side = r / fine
    gx, gy = (np.floor((v - v.min()) / side).astype(np.int64) + fine + 2 for v in (x, y))
    width = int(gx.max()) + fine + 3
    code = gy * width + gx
    order = np.argsort(code, kind="stable")
    code, sx, sy = code[order], x[order], y[order]
    reach = np.arange(-fine - 1, fine + 2)
    gap, far = np.maximum(np.abs(reach) - 1, 0), np.abs(reach) + 1
    least, most = (np.hypot(v[:, None], v[None]) * side for v in (gap, far))  # of the distances between two cells
    touched, inside = least <= r * (1 + 1e-6), most <= r * (1 - 1e-6)
    rows = [(dy, np.flatnonzero(t), np.flatnonzero(i)) for dy, t, i in zip(reach, touched, inside, strict=True) if t.any()]
    # columns touched in each row of cells, and those inside: runs around the middle
    dy = np.array([d for d, _, _ in rows]) * width
    t0, t1 = (np.array([reach[t[e]] for _, t, _ in rows]) for e in (0, -1))
    i0 = np.array([reach[i[0]] if len(i) else z + 1 for (_, _, i), z in zip(rows, t1, strict=True)])
    i1 = np.array([reach[i[-1]] if len(i) else z for (_, _, i), z in zip(rows, t1, strict=True)])
    oc = gy[own] * width + gx[own]
    by = np.argsort(oc, kind="stable")
    starts = np.flatnonzero(np.diff(oc[by], prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(by)], strict=True):
        mine = by[lo:hi]
        c = oc[mine[0]] + dy
        a, b, d, e = (np.searchsorted(code, c + v) for v in (t0, i0, i1 + 1, t1 + 1))
        total = int((d - b).sum())
        rim = np.concatenate([np.arange(s, z) for s, z in zip(np.concatenate([a, d]), np.concatenate([b, e]), strict=True) if s < z] or [np.zeros(0, np.int64)])
        n[mine] = total
        px, py = x[own[mine]], y[own[mine]]
        rx, ry = sx[rim], sy[rim]
        step = max(1, (1 << 18) // max(len(rim), 1))
        for s in range(0, len(mine), step):
            dx, dy2 = px[s : s + step, None] - rx, py[s : s + step, None] - ry
            dx *= dx
            dy2 *= dy2
            dx += dy2
            n[mine[s : s + step]] += np.count_nonzero(dx <= r * r, axis=1)
    # a point isn't its own neighbour, nor are rows with its id
    n -= 1
    at = np.full(len(x), -1)
    at[own] = np.arange(len(own))
    ids = np.argsort(pid, kind="stable")
    for lag in range(1, len(ids)):
        p, q = ids[:-lag], ids[lag:]
        same = pid[p] == pid[q]
        if not same.any():
            break
        p, q = p[same], q[same]
        near = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= r * r
        for v in (p[near], q[near]):
            np.subtract.at(n, at[v][at[v] >= 0], 1)
    return n


def close_counts(points: DataFrame, r: float, key: Sequence[str] = ()) -> DataFrame:
    """``pid`` and ``bad``, how many points of other ids are at most r away; one row for each point with any.

    No pairs are formed: points are dealt to square tiles, with those up to r outside, and counted there.
    Tiles are wide enough to hold ``TILE`` points on average, and those with more than ``OWN`` are cut.
    """
    p = written(finite(points).where("pid is not null").select(*key, "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    box = p.agg(F.count("*").alias("n"), *(f(c).alias(f"{m}{c}") for c in "xy" for m, f in (("lo", F.min), ("hi", F.max)))).first()
    area = max((box.hix - box.lox) * (box.hiy - box.loy), r * r) if box.n else r * r
    side = float(max(r, (area / max(box.n, 1) * TILE) ** 0.5))
    near = lit(r * (1 + 1e-6))

    def tiles(c):
        return F.sequence(F.floor((F.col(c) - near) / lit(side)), F.floor((F.col(c) + near) / lit(side)))

    home = p.withColumns({"_tx": F.floor(F.col("x") / lit(side)), "_ty": F.floor(F.col("y") / lit(side))})
    sizes = home.groupBy(*key, "_tx", "_ty").agg(F.ceil(F.count("*") / OWN).cast("int").alias("_pieces"))
    sent = home.withColumnsRenamed({"_tx": "_hx", "_ty": "_hy"}).withColumn("_tx", F.explode(tiles("x"))).withColumn("_ty", F.explode(tiles("y")))
    cut = sent.join(sizes, [*key, "_tx", "_ty"]).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    mine = (F.col("_hx") == F.col("_tx")) & (F.col("_hy") == F.col("_ty")) & (F.pmod(F.xxhash64("pid"), F.col("_pieces")) == F.col("_piece"))

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in "xy")
        pids = table.column("pid").combine_chunks()
        own = np.flatnonzero(table.column("_own").to_numpy())
        n = _near_counts(x, y, own, pids.dictionary_encode().indices.to_numpy(), r) if len(own) else np.zeros(0, dtype=np.int64)
        return pa.table({"pid": pids.take(pa.array(own[n > 0])), "bad": n[n > 0]})

    kind = p.schema["pid"].dataType.simpleString()
    rows = cut.select(*key, "_tx", "_ty", "_piece", "pid", "x", "y", mine.alias("_own"))
    return rows.groupBy(*key, "_tx", "_ty", "_piece").applyInArrow(run, f"pid {kind}, bad long")


def close_to_lower(points: DataFrame, r: float) -> DataFrame:
    """Ids of points with one of a lower id at most r away: the ``j`` of close pairs, each once.

    Points of a cell of 0.7 r are all close to its lowest, so only the lowest of each cell are compared, with the points of the cells around.
    """
    cell = {c: F.floor(F.col(v) / lit(0.7 * r)) for c, v in (("_gx", "x"), ("_gy", "y"))}
    p = written(finite(points).where("pid is not null").select("pid", "x", "y").withColumns(cell))
    low = p.groupBy("_gx", "_gy").agg(F.min("pid").alias("_low"))
    marked = p.join(low.hint("merge"), ["_gx", "_gy"])
    crowd = marked.where("pid > _low").select("pid")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3) if dx or dy])
    first = marked.where("pid = _low").withColumn("_o", F.explode(steps)).select(
        F.col("pid").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("_gx") + F.col("_o.dx")).alias("_gx"), (F.col("_gy") + F.col("_o.dy")).alias("_gy")
    )
    d2 = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    met = p.join(first.hint("merge"), ["_gx", "_gy"]).where(F.col("pid") < F.col("j")).where(d2 <= r * r)
    return crowd.unionByName(met.select(F.col("j").alias("pid"))).distinct()
