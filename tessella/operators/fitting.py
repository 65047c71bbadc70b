"""Transform fits: least squares, RANSAC, thin-plate splines, residuals, and cells to image pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import affine_xy, homography_xy, lit, matmul


def affine_sums(pairs: DataFrame) -> DataFrame:
    """The sums of the normal equations for (sx, sy) -> (dx, dy): one row, whatever the size."""
    x, y, u, v = (F.col(c).cast("double") for c in ("sx", "sy", "dx", "dy"))
    return pairs.agg(
        F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"),
        F.sum(u).alias("u"), F.sum(x * u).alias("xu"), F.sum(y * u).alias("yu"), F.sum(v).alias("v"), F.sum(x * v).alias("xv"), F.sum(y * v).alias("yv"),
    )


def affine_fit(pairs: DataFrame) -> list[list[float]]:
    """Least-squares 2x3 matrix from the sums."""
    s = affine_sums(pairs).first()
    if s.n < 3:
        raise ValueError("an affine fit needs three points")
    m = np.array([[s.xx, s.xy, s.x], [s.xy, s.yy, s.y], [s.x, s.y, s.n]])
    sol = np.linalg.solve(m, np.array([[s.xu, s.xv], [s.yu, s.yv], [s.u, s.v]]))
    return sol.T.tolist()


def residuals(pairs: DataFrame, m, kind: str = "affine") -> DataFrame:
    """Adds the reprojection error of each pair."""
    px, py = (affine_xy if kind == "affine" else homography_xy)(m, F.col("sx"), F.col("sy"))
    return pairs.withColumn("error", F.hypot(px - F.col("dx"), py - F.col("dy")))


def inlier_summary(pairs: DataFrame, m, threshold: float = 8.0, kind: str = "affine") -> DataFrame:
    e = F.col("error")
    ok = e <= threshold
    return residuals(pairs, m, kind).agg(
        F.count("*").alias("num_points"), F.count_if(ok).alias("num_inliers"), F.avg(F.when(ok, e)).alias("mean_error"), F.median(F.when(ok, e)).alias("median_error")
    )


def homography_fit(s: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """Direct linear transform on normalised points."""
    def norm(p):
        c = p.mean(0)
        k = np.sqrt(2) / max(1e-12, np.sqrt(((p - c) ** 2).sum(1)).mean())
        t = np.array([[k, 0, -k * c[0]], [0, k, -k * c[1]], [0, 0, 1]])
        return np.c_[p, np.ones(len(p))] @ t.T, t

    (a, ta), (b, tb) = norm(s), norm(d)
    z = np.zeros_like(a)
    rows = np.concatenate([np.c_[a, z, -b[:, :1] * a], np.c_[z, a, -b[:, 1:2] * a]])
    try:
        h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    except np.linalg.LinAlgError:
        return None
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _hypotheses(sample: pd.DataFrame, kind: str, n: int, seed: int) -> list[list[list[float]]]:
    need = 3 if kind == "affine" else 4
    rng = np.random.default_rng(seed)
    s, d = sample[["sx", "sy"]].to_numpy(float), sample[["dx", "dy"]].to_numpy(float)
    out = []
    for _ in range(n):
        i = rng.choice(len(s), need, replace=False)
        if kind == "affine":
            a = np.c_[s[i], np.ones(3)]
            if abs(np.linalg.det(a)) < 1e-6:
                continue
            out.append(np.linalg.solve(a, d[i]).T.tolist())
        elif (h := homography_fit(s[i], d[i])) is not None:
            out.append(h.tolist())
    return out


def _inliers(pairs: DataFrame, models: list, threshold: float) -> tuple[int, int]:
    """(inliers, place) of the best of some models; each task counts for all of them over its rows."""
    m = np.array([np.array(x if len(x) == 3 else [*x, [0, 0, 1]]) for x in models])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(m), dtype=np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                p = np.c_[part[["sx", "sy"]].to_numpy(float), np.ones(len(part))]
                q = m @ p.T
                w = np.where(np.abs(q[:, 2]) < 1e-12, 1e-12, q[:, 2])
                e = np.hypot(q[:, 0] / w - part["dx"].to_numpy(float), q[:, 1] / w - part["dy"].to_numpy(float))
                total += (e <= threshold).sum(1)
        yield pd.DataFrame({"h": np.arange(len(m)), "n": total})

    counts = pairs.select("sx", "sy", "dx", "dy").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.desc("n"), "h").first()
    return best.n, best.h


def ransac(
    pairs: DataFrame, kind: str = "affine", threshold: float = 8.0, iterations: int = 10_000, confidence: float = 0.995, seed: int = 7, sample_size: int = 2000, batch: int = 500
) -> tuple[list[list[float]], DataFrame]:
    """Robust fit: hypotheses from a hash sample of bounded size, scored over all pairs, a batch in a pass.

    Returns the matrix, refitted on all inliers, and the pairs with ``error`` and ``inlier``. Batches
    go on up to ``iterations`` hypotheses, or until one of inliers alone has been drawn with
    ``confidence``, by the share of inliers of the best.
    """
    need = 3 if kind == "affine" else 4
    sample = pairs.select("pid", "sx", "sy", "dx", "dy").orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(sample_size).toPandas().sort_values("pid")
    if len(sample) < need:
        raise ValueError(f"{kind} needs at least {need} points")
    total = pairs.count()
    best, most, done = None, -1, 0
    while done < iterations:
        models = _hypotheses(sample, kind, min(batch, iterations - done), seed + done)
        done += batch
        if models:
            n, h = _inliers(pairs, models, threshold)
            if n > most:
                best, most = models[h], n
            clean = min(max(most / total, 0.0), 1.0) ** need
            if clean >= 1 or (clean > 0 and done >= np.log(1 - confidence) / np.log(1 - clean)):
                break
    if best is None:
        raise ValueError("all points lie on a line")
    inside = residuals(pairs, best, kind).where(F.col("error") <= threshold)
    best = affine_fit(inside) if kind == "affine" else homography_over(inside)
    scored = residuals(pairs, best, kind)
    return best, scored.withColumn("inlier", F.col("error") <= threshold)


def homography_over(pairs: DataFrame) -> list[list[float]]:
    """Direct linear transform over any number of pairs, from the sums of its normal equations."""
    m = pairs.agg(*[F.avg(c).alias(c) for c in ("sx", "sy", "dx", "dy")]).first()
    gap = [F.avg(F.hypot(F.col(f"{p}x") - lit(m[f"{p}x"]), F.col(f"{p}y") - lit(m[f"{p}y"]))).alias(p) for p in "sd"]
    size = pairs.agg(*gap).first()
    k = {p: np.sqrt(2) / max(1e-12, size[p]) for p in "sd"}
    x, y, u, v = ((F.col(c) - lit(m[c])) * lit(float(k[c[0]])) for c in ("sx", "sy", "dx", "dy"))
    zero, one = lit(0.0), lit(1.0)
    rows = ([x, y, one, zero, zero, zero, -u * x, -u * y, -u], [zero, zero, zero, x, y, one, -v * x, -v * y, -v])
    sums = [F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])).alias(f"s{i}{j}") for i in range(9) for j in range(i, 9)]
    s = pairs.agg(*sums).first()
    a = np.array([[s[f"s{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
    h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
    to, back = (np.array([[k[p], 0, -k[p] * m[f"{p}x"]], [0, k[p], -k[p] * m[f"{p}y"]], [0, 0, 1]]) for p in "sd")
    h = np.linalg.inv(back) @ h @ to
    return (h / h[2, 2]).tolist()


def spline_fit(s: np.ndarray, d: np.ndarray, reg: float = 1e-2) -> dict[str, list]:
    """Thin-plate spline: solve [[K + reg I, P], [P', 0]] for the weights and the affine part."""
    n = len(s)
    r2 = ((s[:, None] - s[None]) ** 2).sum(2)
    k = np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0) + reg * np.eye(n)
    p = np.c_[np.ones(n), s]
    a = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    w = np.linalg.solve(a, np.r_[d, np.zeros((3, 2))])
    return {"ctrl": s.tolist(), "w": w[:n].tolist(), "a": w[n:].tolist()}


#: Control pairs of a spline, at most: its fit is a dense solve.
MAX_CONTROLS = 2000


def control_pairs(pairs: DataFrame, cell: float) -> DataFrame:
    """The mean pair of each grid cell: as many control pairs as the image has cells, from any number of pairs."""
    grid = {"gx": F.floor(F.col("sx") / lit(cell)), "gy": F.floor(F.col("sy") / lit(cell))}
    return pairs.withColumns(grid).groupBy("gx", "gy").agg(*[F.avg(c).alias(c) for c in ("sx", "sy", "dx", "dy")])


def spline_from(pairs: DataFrame, reg: float = 1e-2) -> dict[str, list]:
    """Spline over all pairs, in order of place. More than ``MAX_CONTROLS`` are an error; see ``control_pairs``."""
    few = pairs.select("sx", "sy", "dx", "dy").limit(MAX_CONTROLS + 1).toPandas().sort_values(["sx", "sy"], kind="stable")
    if len(few) > MAX_CONTROLS:
        raise ValueError(f"a spline has at most {MAX_CONTROLS} control pairs; thin them out by control_pairs")
    return spline_fit(few[["sx", "sy"]].to_numpy(float), few[["dx", "dy"]].to_numpy(float), reg)


def spline_xy(model: dict[str, list], x: Column, y: Column) -> tuple[Column, Column]:
    """The spline as a column expression over an array of its control points."""
    ctrl = F.array(*[F.array(*map(lit, [*c, *w])) for c, w in zip(model["ctrl"], model["w"], strict=True)])

    def part(k: int) -> Column:
        def add(acc: Column, c: Column) -> Column:
            r2 = (x - c[0]) ** 2 + (y - c[1]) ** 2
            return acc + c[2 + k] * F.when(r2 > 0, r2 * F.log(r2)).otherwise(lit(0))

        a = [row[k] for row in model["a"]]
        return F.aggregate(ctrl, lit(a[0]) + lit(a[1]) * x + lit(a[2]) * y, add)

    return part(0), part(1)


def stage_to_image(origin_x: float, origin_y: float, pixel_x: float, pixel_y: float) -> list[list[float]]:
    """Microns to level-0 pixels; the origin is added as it stands."""
    return [[1 / pixel_x, 0.0, origin_x], [0.0, 1 / pixel_y, origin_y], [0.0, 0.0, 1.0]]


def project_cells(cells: DataFrame, meta: dict[str, float], transform: dict, x: str = "x_centroid", y: str = "y_centroid") -> DataFrame:
    """Cell centroids from microns to target pixels; other columns pass through.

    An affine or projective transform is first multiplied with the stage map, so that a row sees
    one matrix. A pure projection: no shuffle, and only the columns asked for are read.
    """
    for c in (x, y):
        if c not in cells.columns:
            raise ValueError(f"cells lack the column {c}")
    stage = stage_to_image(meta["origin_x"], meta["origin_y"], meta["pixel_x"], meta["pixel_y"])
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    kind = transform_kind(transform)
    if kind == "tps":
        u, v = spline_xy(transform["tps"], *affine_xy(stage, cx, cy))
    elif kind == "affine":
        u, v = affine_xy(matmul([*map(list, transform["matrix"][:2]), [0, 0, 1]], stage), cx, cy)
    else:
        u, v = homography_xy(matmul(transform["matrix"], stage), cx, cy)
    return cells.withColumns({"x_image": u, "y_image": v})


def transform_kind(transform: dict) -> str:
    """The declared type ("local_tps" is "tps"), or the one that the keys imply."""
    named = transform.get("transform_type")
    if named:
        kind = {"local_tps": "tps"}.get(named, named)
        if kind not in ("affine", "homography", "tps"):
            raise ValueError(f"unknown transform type {named}")
        return kind
    if "tps" in transform:
        return "tps"
    return "affine" if len(transform["matrix"]) == 2 else "homography"
