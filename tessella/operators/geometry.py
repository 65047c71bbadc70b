"""Tiles, quads and points: boxes, pruning, projection, geometry of crops and patches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_even, homography_xy, lit


def boxes(points: DataFrame, size: float) -> DataFrame:
    """Square boxes centred on points."""
    half = lit(size / 2)
    return points.withColumns({"x0": F.col("x") - half, "y0": F.col("y") - half, "w": lit(size), "h": lit(size)})


def clamped(tiles: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """Scaled, rounded (half to even) and cut to the image; tiles that end up empty go."""
    cut = tiles.withColumns(
        {
            "cx0": clamp(half_even(F.col("x0") * lit(scale)).cast("long"), 0, width),
            "cy0": clamp(half_even(F.col("y0") * lit(scale)).cast("long"), 0, height),
            "cx1": clamp(half_even((F.col("x0") + F.col("w")) * lit(scale)).cast("long"), 0, width),
            "cy1": clamp(half_even((F.col("y0") + F.col("h")) * lit(scale)).cast("long"), 0, height),
        }
    )
    return cut.where("cx1 > cx0 and cy1 > cy0")


def expanded(tiles: DataFrame, margin: float) -> DataFrame:
    """Grown on every side by a share of its size."""
    dx, dy = F.col("w") * lit(margin), F.col("h") * lit(margin)
    return tiles.withColumns({"x0": F.col("x0") - dx, "y0": F.col("y0") - dy, "w": F.col("w") + 2 * dx, "h": F.col("h") + 2 * dy})


CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def quads(tiles: DataFrame, m, guard: str = "sign") -> DataFrame:
    """Projected corners qx0..qy3 of boxes, in order TL, TR, BR, BL."""
    out = {}
    for i, (u, v) in enumerate(CORNERS):
        x, y = F.col("x0") + F.col("w") * lit(u), F.col("y0") + F.col("h") * lit(v)
        out[f"qx{i}"], out[f"qy{i}"] = homography_xy(m, x, y, guard)
    return tiles.withColumns(out)


def quad_points() -> list[tuple[Column, Column]]:
    return [(F.col(f"qx{i}"), F.col(f"qy{i}")) for i in range(4)]


def bbox_overlap(tiles: DataFrame, width: float, height: float) -> DataFrame:
    """Share of each box inside the image, as ``ratio``; null for boxes without area."""
    ix = F.greatest(lit(0), F.least(F.col("x0") + F.col("w"), lit(width)) - F.greatest(F.col("x0"), lit(0)))
    iy = F.greatest(lit(0), F.least(F.col("y0") + F.col("h"), lit(height)) - F.greatest(F.col("y0"), lit(0)))
    area = F.col("w") * F.col("h")
    return tiles.withColumn("ratio", F.when(area > 0, ix * iy / area))


def _clip(poly: np.ndarray, width: float, height: float) -> np.ndarray:
    """Convex polygon cut to a rectangle, edge by edge."""
    for axis, limit, keep_low in ((0, 0.0, False), (0, width, True), (1, 0.0, False), (1, height, True)):
        if not len(poly):
            break
        d = (limit - poly[:, axis]) if keep_low else (poly[:, axis] - limit)
        out = []
        for i in range(len(poly)):
            a, b = poly[i - 1], poly[i]
            da, db = d[i - 1], d[i]
            if (da >= 0) != (db >= 0):
                out.append(a + (b - a) * (da / (da - db)))
            if db >= 0:
                out.append(b)
        poly = np.array(out).reshape(-1, 2)
    return poly


def _area(poly: np.ndarray) -> float:
    if len(poly) < 3:
        return 0.0
    x, y = poly[:, 0], poly[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def prune_outside(tiles: DataFrame, m, width: float, height: float, min_ratio: float = 0.15, centre_inside: bool = False) -> DataFrame:
    """Tiles whose projected quad overlaps the image by ``min_ratio`` of its area, with that ``ratio``.

    Quads that aren't finite or have no area go. The polygons are clipped in Arrow batches.
    """
    projected = quads(tiles, m)
    names = [f"q{c}{i}" for i in range(4) for c in "xy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = pdf[names].to_numpy(dtype=float).reshape(-1, 4, 2)
            ratio = np.full(len(q), -1.0)
            for i, poly in enumerate(q):
                if np.isfinite(poly).all() and (area := _area(poly)) > 1e-9:
                    c = poly.mean(0)
                    if not centre_inside or (0 <= c[0] < width and 0 <= c[1] < height):
                        ratio[i] = _area(_clip(poly, width, height)) / area
            yield pdf.drop(columns=names).assign(ratio=ratio)[ratio >= min_ratio]

    return projected.mapInPandas(run, tiles.withColumn("ratio", lit(0)).schema)


def rectified_size(points: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Width and height of a rectified tile: mean of opposite edges, rounded, at least 2."""

    def edge(i, j):
        (a, b), (c, d) = points[i], points[j]
        return F.hypot(c - a, d - b)

    w = half_even((edge(0, 1) + edge(3, 2)) / 2).cast("long")
    h = half_even((edge(0, 3) + edge(1, 2)) / 2).cast("long")
    return F.greatest(F.lit(2), w), F.greatest(F.lit(2), h)


def corner_order(corners: DataFrame, key: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Which of the corners (i, x, y) is TL, TR, BR, BL: extremes of x+y and x-y, the first on ties."""
    s, d = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    i = F.col("i")
    return corners.groupBy(*key).agg(
        F.min(F.struct(s, i)).getField("i").alias("tl"), (-F.max(F.struct(d, (-i).alias("i"))).getField("i")).alias("tr"),
        (-F.max(F.struct(s, (-i).alias("i"))).getField("i")).alias("br"), F.min(F.struct(d, i)).getField("i").alias("bl"),
    )


def extraction_level(x: Column, k: Column, low: int = 1, high: int = 6, base: float = 50.0) -> Column:
    """Level x less the number of doublings of k over the base, within [low, high]."""
    return clamp(x - half_even(F.log2(k / lit(base))).cast("long"), low, high)


def patch_level(level: Column) -> Column:
    return F.greatest(F.lit(0), level - 1)


def patch_length(length: Column, m, source_level: int, target_level: int, margin: float = 1.1) -> Column:
    """Patch side on the target: the larger row norm times the level step and margin, ceiled, made even."""
    norm = max((m[0][0] ** 2 + m[0][1] ** 2) ** 0.5, (m[1][0] ** 2 + m[1][1] ** 2) ** 0.5)
    n = F.ceil(length * lit(norm * 2.0 ** (source_level - target_level) * margin)).cast("long")
    return n + n % 2


def patch_box(x: Column, y: Column, length: int, width: int, height: int) -> dict[str, Column]:
    """Crop of a side around a rounded centre, kept inside the image."""
    half = length // 2
    cx = clamp(half_even(x).cast("long"), 0, width - 1)
    cy = clamp(half_even(y).cast("long"), 0, height - 1)
    return {
        "px0": F.greatest(F.lit(0), cx - half), "py0": F.greatest(F.lit(0), cy - half),
        "px1": F.least(F.lit(width), cx + half), "py1": F.least(F.lit(height), cy + half),
    }


def from_aligned(x: Column, y: Column, scale: Column, tx: Column, ty: Column, w: int, h: int, px: Column, py: Column, base: Column) -> tuple[Column, Column]:
    """Aligned canvas back to the moving mask: undo the centred warp, the padding and the base scale."""
    cx, cy = w // 2, h // 2
    return ((x - tx - cx) / scale + cx - px) / base, ((y - ty - cy) / scale + cy - py) / base


def scale_range(median: Column, share: float) -> tuple[Column, Column]:
    return F.greatest(lit(0.5), median * lit(1 - share)), F.least(lit(3.0), median * lit(1 + share))


def fit_and_pad(w: Column, h: Column, box_w: int, box_h: int) -> dict[str, Column]:
    """Scale to fit a box, and the padding that centres the result."""
    s = F.least(lit(box_w) / w, lit(box_h) / h)
    nw, nh = F.greatest(F.lit(1), F.floor(w * s)), F.greatest(F.lit(1), F.floor(h * s))
    return {"scale": s, "nw": nw, "nh": nh, "px": F.floor((F.lit(box_w) - nw) / 2), "py": F.floor((F.lit(box_h) - nh) / 2)}


def dot_radius(side: Column, base: float = 3.0, per: float = 256.0) -> Column:
    return F.greatest(F.lit(1), half_even(lit(base) * side / lit(per)).cast("long"))


def tile_grid(spark, width: int, height: int, tile: int) -> DataFrame:
    """Destination tiles of a full-size export, the last ones smaller."""
    nx, ny = -(-width // tile), -(-height // tile)
    i = spark.range(nx * ny)
    x0, y0 = (F.col("id") % nx) * tile, F.floor(F.col("id") / nx) * tile
    return i.select(
        F.col("id").alias("tile_id"), x0.alias("x0"), y0.alias("y0"),
        F.least(F.lit(tile), F.lit(width) - x0).alias("w"), F.least(F.lit(tile), F.lit(height) - y0).alias("h"),
    )


def source_windows(grid: DataFrame, inverse, width: int, height: int, pad: int = 2) -> DataFrame:
    """Source window of each destination tile: box of its back-projected corners, padded and cut."""
    q = quads(grid, inverse)
    xs, ys = zip(*quad_points(), strict=True)
    cut = q.select(
        "tile_id",
        clamp(F.floor(F.least(*xs)) - pad, 0, width).alias("sx0"), clamp(F.floor(F.least(*ys)) - pad, 0, height).alias("sy0"),
        clamp(F.ceil(F.greatest(*xs)) + pad, 0, width).alias("sx1"), clamp(F.ceil(F.greatest(*ys)) + pad, 0, height).alias("sy1"),
    )
    return cut.where("sx1 > sx0 and sy1 > sy0")
