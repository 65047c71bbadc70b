"""Functions for SQL: point maps, fits as aggregates, table functions for grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udtf(returnType="tile_id long, x0 long, y0 long, w long, h long")
class TileGrid:
    """Tiles of a size over an image, the last ones smaller."""

    def eval(self, width: int, height: int, tile: int):
        i = 0
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                yield i, x, y, min(tile, width - x), min(tile, height - y)
                i += 1


@F.udtf(returnType="scale double, tx int, ty int")
class SearchGrid:
    """Scales from lo to hi by step, with all shifts up to reach by stride."""

    def eval(self, lo: float, hi: float, step: float, reach: int, stride: int):
        lo, hi, step = float(lo), float(hi), float(step)
        for i in range(int((hi - lo) / step + 1e-9) + 1):
            for tx in range(-reach, reach + 1, stride):
                for ty in range(-reach, reach + 1, stride):
                    yield lo + i * step, tx, ty


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fit_affine(sx: pd.Series, sy: pd.Series, dx: pd.Series, dy: pd.Series) -> list:
    """Least-squares affine of a group, as six numbers; null for fewer than three points."""
    if len(sx) < 3:
        return None
    a = np.c_[sx, sy, np.ones(len(sx))]
    sol, _, rank, _ = np.linalg.lstsq(a, np.c_[dx, dy], rcond=None)
    return sol.T.reshape(-1).tolist() if rank == 3 else None


@F.pandas_udf(T.IntegerType())
def otsu_threshold(v: pd.Series) -> int:
    """Otsu's threshold of a group of 8-bit values; the least one on ties."""
    n = np.bincount(v.astype(int), minlength=256).astype(float)
    s = n * np.arange(256)
    n0, s0 = n.cumsum(), s.cumsum()
    n1, s1 = n0[-1] - n0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n0 > 0) & (n1 > 0), n0 * n1 * (s0 / n0 - s1 / n1) ** 2, -1)
    return int(v.iloc[0]) if score.max() < 0 else int(np.argmax(np.round(score, 6)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fit_tps(sx: pd.Series, sy: pd.Series, dx: pd.Series, dy: pd.Series) -> list:
    """Thin-plate spline of a group: six numbers of the affine part (constant, x, y; first of x, then of y), then each control's place and
    weights; null for fewer than three pairs or controls on a line. More than ``MAX_CONTROLS`` pairs are an error."""
    from ..operators.fitting import MAX_CONTROLS, spline_fit

    if len(sx) > MAX_CONTROLS:
        raise ValueError(f"a spline has at most {MAX_CONTROLS} control pairs")
    s = np.c_[sx, sy].astype(float)
    if len(s) < 3 or np.linalg.matrix_rank(s - s.mean(0)) < 2:
        return None
    model = spline_fit(s, np.c_[dx, dy].astype(float))
    return [*np.array(model["a"]).T.reshape(-1).tolist(), *np.c_[model["ctrl"], model["w"]].reshape(-1).tolist()]


def _over_images(kernel):
    """A function of a flat image and its width, a whole column at a time."""

    def run(v: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else kernel(np.asarray(a).reshape(-1, w)).reshape(-1).tolist() for a, w in zip(v, width, strict=True)])

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def label_components(v: pd.Series, width: pd.Series) -> pd.Series:
    """Labels of the 8-connected components of a flat mask; 0 is the ground."""
    from ..operators.masks import label_image

    return _over_images(lambda a: label_image(a > 0))(v, width)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nuclei_mask_dapi(v: pd.Series, width: pd.Series) -> pd.Series:
    """Nuclei of a flat fluorescence tile, enlarged twofold: 0 for nuclei, 255 for ground."""
    from ..plans.aligning import dark_nuclei_mask

    return _over_images(lambda a: dark_nuclei_mask(a.astype(float)))(v, width)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nuclei_mask_he(rgb: pd.Series, width: pd.Series) -> pd.Series:
    """Nuclei of a flat stained tile (colours of a pixel side by side), enlarged twofold: objects numbered from 1, 0 for ground."""
    from ..plans.aligning import histology_mask

    return _over_images(lambda a: histology_mask(a.reshape(len(a), -1, 3).astype(float))[1])(rgb, width * 3)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for kind in "xy":
        a, b, c = {"x": ("m[0]", "m[1]", "m[2]"), "y": ("m[3]", "m[4]", "m[5]")}[kind]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION img_affine_{kind}(m ARRAY<DOUBLE>, px DOUBLE, py DOUBLE) RETURNS DOUBLE RETURN {a} * px + {b} * py + {c}")
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION img_homography_{kind}(m ARRAY<DOUBLE>, px DOUBLE, py DOUBLE) RETURNS DOUBLE "
            f"RETURN ({a} * px + {b} * py + {c}) / greatest(m[6] * px + m[7] * py + m[8], 1e-8D)"
        )
        k = "xy".index(kind)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION img_tps_{kind}(m ARRAY<DOUBLE>, px DOUBLE, py DOUBLE) RETURNS DOUBLE RETURN "
            f"aggregate(sequence(6, size(m) - 4, 4), m[{3 * k}] + m[{3 * k + 1}] * px + m[{3 * k + 2}] * py, (t, i) -> t + m[i + {2 + k}] * "
            "CASE WHEN m[i] = px AND m[i + 1] = py THEN 0D ELSE (pow(px - m[i], 2) + pow(py - m[i + 1], 2)) * ln(pow(px - m[i], 2) + pow(py - m[i + 1], 2)) END)"
        )
    spark.udtf.register("tile_grid", TileGrid)
    spark.udtf.register("search_grid", SearchGrid)
    spark.udf.register("fit_affine", fit_affine)
    spark.udf.register("otsu_threshold", otsu_threshold)
    spark.udf.register("fit_tps", fit_tps)
    spark.udf.register("label_components", label_components)
    spark.udf.register("nuclei_mask_dapi", nuclei_mask_dapi)
    spark.udf.register("nuclei_mask_he", nuclei_mask_he)


def worker_per_file(files, worker, ddl: str):
    """Run a function on every (path, content); it returns a table of the given schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield worker(path, bytes(content))

    return files.select("path", "content").mapInPandas(run, ddl)
