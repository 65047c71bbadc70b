"""Projection queries: intensities, orientations, coordinate maps, small geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import lit
from ..operators import fitting, geometry, masks, raster, search
from .adapters import ANCHOR_MAP, HOMOGRAPHY
from .registry import query

H = HOMOGRAPHY
_STAIN = raster.stain_rows()


def _mm(inner: str, cols: str = "tile_id, y, x") -> str:
    """Truncated min-max to 0..255 per tile of a query with column v."""
    return (
        f"SELECT {cols}, trunc(round(coalesce((v - min(v) OVER (PARTITION BY tile_id)) * 255.0::DOUBLE / "
        f"nullif(CAST(max(v) OVER (PARTITION BY tile_id) - min(v) OVER (PARTITION BY tile_id) AS DOUBLE), 0), 0), 9)) AS v FROM ({inner})"
    )


_OD = " + ".join(f"{k!r}::DOUBLE * -ln(({c} + 1.0::DOUBLE) / 255.0::DOUBLE)" for k, c in zip(_STAIN[0], "rgb", strict=True))


@query("pj01_hematoxylin", "tile_id:l y:l x:l v:l", _mm(f"SELECT tile_id, y, x, {_OD} AS v FROM rgb"))
def _(s):
    return raster.hematoxylin(s.rgb)


_STRETCH = """SELECT tile_id, y, x, trunc(round(coalesce(greatest(0, least(1, (v - lo) / nullif(hi - lo, 0))) * 255, 0), 9)) AS v
FROM px JOIN (SELECT tile_id, quantile_cont(v, {a}) AS lo, quantile_cont(v, {b}) AS hi FROM px GROUP BY tile_id) USING (tile_id)"""


@query("pj02_stretch", "tile_id:l y:l x:l v:l", _STRETCH.format(a=0.02, b=0.98))
def _(s):
    return raster.stretch(s.px, 0.02, 0.98)


@query("pj02_sharpen", "tile_id:l y:l x:l v:l", """
SELECT c.tile_id, c.y, c.x, greatest(0, least(255, sum(n.v * CASE WHEN n.y = c.y AND n.x = c.x THEN 5 ELSE -1 END))) AS v
FROM px c JOIN px n ON c.tile_id = n.tile_id AND abs(c.y - n.y) + abs(c.x - n.x) <= 1 GROUP BY c.tile_id, c.y, c.x""")
def _(s):
    return raster.sharpen(s.px)


@query("pj02_clahe", "tile_id:l y:l x:l v:l")
def _(s):
    return masks.per_image(s.px, clahe, "v", value="v").select("tile_id", "y", "x", "v")


def clahe(a: np.ndarray, clip: float = 2.0, grid: int = 2) -> np.ndarray:
    """Contrast-limited equalisation: histograms of grid blocks, clipped, interpolated between block centres."""
    h, w = a.shape
    bh, bw = -(-h // grid), -(-w // grid)
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            block = a[i * bh : (i + 1) * bh, j * bw : (j + 1) * bw].astype(int).reshape(-1)
            n = np.bincount(block, minlength=256).astype(float)
            limit = max(1.0, clip * block.size / 256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over / 256
            maps[i, j] = np.round(n.cumsum() * 255 / max(1, block.size))
    fy = np.clip((np.arange(h) + 0.5) / bh - 0.5, 0, grid - 1)
    fx = np.clip((np.arange(w) + 0.5) / bw - 0.5, 0, grid - 1)
    y0, x0 = np.minimum(fy.astype(int), grid - 1), np.minimum(fx.astype(int), grid - 1)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    ty, tx = (fy - y0)[:, None], (fx - x0)[None, :]
    v = a.astype(int)

    def at(i, j):
        return maps[i[:, None], j[None, :], v]

    out = (1 - ty) * ((1 - tx) * at(y0, x0) + tx * at(y0, x1)) + ty * ((1 - tx) * at(y1, x0) + tx * at(y1, x1))
    return np.clip(np.round(out), 0, 255)


@query("pj03_lut_colour", "tile_id:l y:l x:l r:l g:l b:l", f"""
SELECT tile_id, y, x, 255 - v AS r, 255 - v AS g, 255 - v AS b FROM ({_mm("SELECT tile_id, y, x, greatest(v, 100) AS v FROM px")})""")
def _(s):
    return raster.apply_lut(raster.lut_index(s.px, 100), raster.inverted_lut(s.spark))


@query("pj04_upsample", "tile_id:l y:l x:l v:l", """
SELECT tile_id, y * 2 + i AS y, x * 2 + j AS x, v FROM px, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""")
def _(s):
    return raster.upsample(s.px, 2)


# The reference stains' optical densities (red, green, blue) and their largest concentrations.
STAINS = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581))
STAIN_MOST = (1.9705, 1.0308)


def stain_normalise(rgb: np.ndarray, io: float = 240.0, alpha: float = 1.0, beta: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Macenko: stain directions from the extreme angles in the plane of largest variance.

    Returns three 8-bit images: the normalised one, and that of each stain alone. None where too few pixels absorb.
    """
    target, most = np.array(STAINS), np.array(STAIN_MOST)
    od = -np.log((rgb.reshape(-1, 3).astype(float) + 1) / io)
    solid = od[(od >= beta).all(1)]
    if len(solid) < 4:
        return None
    plane = np.linalg.eigh(np.cov(solid.T))[1][:, 1:3]
    angle = np.arctan2(*(solid @ plane).T[::-1])
    first, second = sorted((plane @ [np.cos(t), np.sin(t)] for t in np.percentile(angle, [alpha, 100 - alpha])), key=lambda v: -v[0])
    amount = np.linalg.lstsq(np.column_stack([first, second]), od.T, rcond=None)[0]
    top = np.percentile(amount, 99, axis=1)
    amount *= (most / np.where(np.abs(top) < 1e-12, 1, top))[:, None]

    def image(density: np.ndarray) -> np.ndarray:
        light = io * np.exp(-density.T)
        return np.where(light > 255, 254, light).astype(np.uint8).reshape(rgb.shape)

    return image(target @ amount), *(image(np.outer(target[:, i], amount[i])) for i in (0, 1))


@query("pj05_stain_normalise", "tile_id:l y:l x:l " + " ".join(f"{i}{c}:l" for i in "nhe" for c in "rgb"))
def _(s):
    import pandas as pd

    names = [f"{i}{c}" for i in "nhe" for c in "rgb"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = pdf[["r", "g", "b"]].to_numpy()
        got = stain_normalise(rgb)
        values = np.hstack([rgb] * 3 if got is None else got).astype(int)
        return pdf[["tile_id", "y", "x"]].assign(**{n: values[:, i] for i, n in enumerate(names)})

    return s.rgb.groupBy("tile_id").applyInPandas(run, "tile_id long, y int, x int, " + ", ".join(f"{n} int" for n in names))


@query("pj05_covariance", "tile_id:l rr:d rg:d bb:d", """
SELECT tile_id, covar_samp(r, r) AS rr, covar_samp(r, g) AS rg, covar_samp(b, b) AS bb FROM (
  SELECT tile_id, -ln((r + 1.0::DOUBLE) / 240) AS r, -ln((g + 1.0::DOUBLE) / 240) AS g, -ln((b + 1.0::DOUBLE) / 240) AS b FROM rgb) GROUP BY tile_id""")
def _(s):
    od = s.rgb.select("tile_id", *[(-F.log((F.col(c) + lit(1)) / lit(240))).alias(c) for c in "rgb"])
    return od.groupBy("tile_id").agg(F.covar_samp("r", "r").alias("rr"), F.covar_samp("r", "g").alias("rg"), F.covar_samp("b", "b").alias("bb"))


@query("pj06_luminance", "tile_id:l y:l x:l v:d", "SELECT tile_id, y, x, 0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b AS v FROM rgb")
def _(s):
    return s.rgb.withColumn("v", raster.luminance(F.col("r"), F.col("g"), F.col("b")))


@query("pj07_u16_to_u8", "tile_id:l y:l x:l v:l", """
SELECT tile_id, y, x, trunc(round((v - lo) * 255.0::DOUBLE / (hi - lo + 1e-8::DOUBLE), 9)) AS v FROM (SELECT tile_id, y, x, v * 257 AS v FROM px)
JOIN (SELECT tile_id, min(v) * 257 AS lo, max(v) * 257 AS hi FROM px GROUP BY tile_id) USING (tile_id)""")
def _(s):
    return raster.minmax_u8(s.px.withColumn("v", F.col("v") * 257), eps=1e-8)


@query("pj08_minmax_whole", "y:l x:l v:l", """
SELECT y, x, trunc((v - lo) * 255.0::DOUBLE / nullif(CAST(hi - lo AS DOUBLE), 0)) AS v FROM big, (SELECT min(v) AS lo, max(v) AS hi FROM big)""")
def _(s):
    return raster.minmax_u8(s.big, ())


@query("pj09_grey_u8", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS v FROM rgb")
def _(s):
    return s.rgb.withColumn("v", raster.grey_u8(F.col("r"), F.col("g"), F.col("b")))


@query("pj10_percentile_stretch", "tile_id:l y:l x:l v:l", _STRETCH.format(a=0.01, b=0.997))
def _(s):
    return raster.stretch(s.px, 0.01, 0.997)


@query("pj11_first_channel", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, r * 256 AS v FROM rgb")
def _(s):
    return s.rgb.select("tile_id", "y", "x", (F.col("r") * 256).alias("v"))


def _case_sql(expr: list[str]) -> str:
    return "CASE tile_id % 8 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expr)) + " END"


_FX = ["x", "15 - y", "7 - x", "y", "x", "7 - x", "y", "15 - y"]
_FY = ["y", "x", "15 - y", "7 - x", "15 - y", "y", "x", "7 - x"]
_TALL = "(SELECT tile_id // 2 AS tile_id, y + 8 * (tile_id % 2) AS y, x, v FROM px)"


def _tall(s):
    """Images of 8 x 16 pixels: every second tile below the one before."""
    return s.px.select(F.floor(F.col("tile_id") / 2).alias("tile_id"), (F.col("y") + 8 * (F.col("tile_id") % 2)).cast("int").alias("y"), "x", "v")



@query("pj12_orient", "tile_id:l y:l x:l v:l", f"SELECT tile_id, {_case_sql(_FY)} AS y, {_case_sql(_FX)} AS x, v FROM {_TALL}")
def _(s):
    x, y = C.orient_by((F.col("tile_id") % 8).cast("int"), F.col("x"), F.col("y"), F.lit(8), F.lit(16))
    return _tall(s).select("tile_id", y.alias("y"), x.alias("x"), "v")


@query("pj13_orient_tile", "tile_id:l y:l x:l v:l", f"SELECT tile_id, {_case_sql([*_FY[:6], '15 - y', _FY[7]])} AS y, {_case_sql([*_FX[:6], 'x', _FX[7]])} AS x, v FROM {_TALL}")
def _(s):
    x, y = C.orient_by((F.col("tile_id") % 8).cast("int"), F.col("x"), F.col("y"), F.lit(8), F.lit(16), compat_case6=True)
    return _tall(s).select("tile_id", y.alias("y"), x.alias("x"), "v")


@query("pj14_unorient_hw", "tile_id:l y:l x:l y0:l x0:l", f"SELECT tile_id, y, x, y AS y0, x AS x0 FROM {_TALL}")
def _(s):
    case = (F.col("tile_id") % 8).cast("int")
    x, y = C.orient_by(case, F.col("x"), F.col("y"), F.lit(8), F.lit(16))
    turned = case.isin(1, 3, 6, 7)
    done = _tall(s).withColumns({"ox": x, "oy": y, "ow": F.when(turned, 16).otherwise(8), "oh": F.when(turned, 8).otherwise(16)})
    bx, by = C.unorient_oriented_by(case, F.col("ox"), F.col("oy"), F.col("ow"), F.col("oh"))
    return done.select("tile_id", "y", "x", by.alias("y0"), bx.alias("x0"))


_UX = ["x", "y", "7 - x", "7 - y", "x", "7 - x", "y", "7 - y"]
_UY = ["y", "7 - x", "7 - y", "x", "7 - y", "y", "x", "7 - x"]


@query("pj15_unorient_wh", "tile_id:l y:l x:l y0:l x0:l", f"SELECT tile_id, y, x, {_case_sql(_UY)} AS y0, {_case_sql(_UX)} AS x0 FROM px")
def _(s):
    x, y = C.unorient_by((F.col("tile_id") % 8).cast("int"), F.col("x"), F.col("y"), F.lit(8), F.lit(8))
    return s.px.select("tile_id", "y", "x", y.alias("y0"), x.alias("x0"))


#: Turns and flips of a w x h image as matrices: the place in the result of a source place.
def turn(op: str, w: int, h: int) -> list[list[float]]:
    return {
        "cw": [[0, -1, h - 1], [1, 0, 0], [0, 0, 1]], "ccw": [[0, 1, 0], [-1, 0, w - 1], [0, 0, 1]],
        "flip_v": [[1, 0, 0], [0, -1, h - 1], [0, 0, 1]], "flip_h": [[-1, 0, w - 1], [0, 1, 0], [0, 0, 1]],
    }[op]


@query("pj16_accumulate_turns", "pid:l u:d v:d", "SELECT pid, y AS u, 7 - x AS v FROM (SELECT pid, x, 4 - y AS y FROM pts)")
def _(s):
    # a vertical flip of an 8 x 5 image, then a turn against the clock
    x, y = C.affine_xy(C.matmul(turn("ccw", 8, 5), turn("flip_v", 8, 5)), F.col("x"), F.col("y"))
    return s.pts.select("pid", x.alias("u"), y.alias("v"))


#: The linear parts of the eight orientation cases.
CASE_PARTS = ((1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (1, 0, 0, -1), (-1, 0, 0, 1), (0, 1, 1, 0), (0, -1, -1, 0))


@query("pj17_infer_case", "n_nationkey:l case_id:l", "SELECT n_nationkey, n_nationkey % 8 AS case_id FROM nation WHERE n_nationkey % 9 <> 8")
def _(s):
    cases = s.spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(CASE_PARTS)], "case_id int, a double, b double, c double, d double")
    n = F.col("n_nationkey")
    part = F.element_at(F.array(*[F.array(*map(lit, p)) for p in CASE_PARTS]), n % 8 + 1)
    rows = s.table("nation").select(n, F.transform(part, lambda v: v + F.when(n % 9 == 8, lit(0.3)).otherwise(lit(3e-5))).alias("p"))
    near = [F.abs(F.col("p")[i] - F.col(c)) <= lit(1e-4) + lit(1e-5) * F.abs(F.col(c)) for i, c in enumerate("abcd")]
    return rows.join(F.broadcast(cases), near[0] & near[1] & near[2] & near[3]).select("n_nationkey", "case_id")


def _hsql(guard: str, k: int) -> str:
    a, b, c = H[k]
    g, h, i = H[2]
    w = f"({g}::DOUBLE * x + {h}::DOUBLE * y + {i})"
    return f"({a}::DOUBLE * x + {b}::DOUBLE * y + {c}) / {guard.format(w=w)}"


_SPLINE_S = np.array([[0.0, 0.0], [3000.0, 0.0], [0.0, 900.0], [3000.0, 900.0], [1500.0, 450.0]])
_SPLINE = fitting.spline_fit(_SPLINE_S, _SPLINE_S + np.array([[5, 3], [-4, 6], [2, -7], [8, 1], [-3, 9]]), 1e-2)


def _spline_sql(k: int) -> str:
    a = [row[k] for row in _SPLINE["a"]]
    terms = [f"{a[0]!r}::DOUBLE + {a[1]!r}::DOUBLE * x + {a[2]!r}::DOUBLE * y"]
    for (cx, cy), w in zip(_SPLINE["ctrl"], _SPLINE["w"], strict=True):
        r2 = f"(pow(x - {cx!r}, 2) + pow(y - {cy!r}, 2))"
        terms.append(f"{w[k]!r}::DOUBLE * CASE WHEN {r2} > 0 THEN {r2} * ln({r2}) ELSE 0 END")
    return " + ".join(terms)


@query("pj18_point_maps", "pid:l ax:d ay:d hx:d hy:d tx:d ty:d", f"""
SELECT pid, 1.02::DOUBLE * x - 0.03::DOUBLE * y + 40 AS ax, 0.02::DOUBLE * x + 0.98::DOUBLE * y - 25 AS ay,
 {_hsql("greatest({w}, 1e-8::DOUBLE)", 0)} AS hx, {_hsql("greatest({w}, 1e-8::DOUBLE)", 1)} AS hy, {_spline_sql(0)} AS tx, {_spline_sql(1)} AS ty FROM pts""")
def _(s):
    x, y = F.col("x"), F.col("y")
    pairs = [C.affine_xy(ANCHOR_MAP, x, y), C.homography_xy(H, x, y), fitting.spline_xy(_SPLINE, x, y)]
    return s.pts.select("pid", *[c.alias(n) for n, c in zip(("ax", "ay", "hx", "hy", "tx", "ty"), [v for p in pairs for v in p], strict=True)])


@query("pj19_homography_point", "pid:l u:d v:d", f"""
SELECT pid, {_hsql("(CASE WHEN abs({w}) > 1e-12 THEN {w} ELSE 1e-12::DOUBLE END)", 0)} AS u, {_hsql("(CASE WHEN abs({w}) > 1e-12 THEN {w} ELSE 1e-12::DOUBLE END)", 1)} AS v FROM pts""")
def _(s):
    u, v = C.homography_xy(H, F.col("x"), F.col("y"), "replace")
    return s.pts.select("pid", u.alias("u"), v.alias("v"))


@query("pj20_quad_projection", "pid:l u:d v:d", f"""
SELECT pid, {_hsql("(CASE WHEN abs({w}) < 1e-9 THEN CASE WHEN {w} < 0 THEN -1e-9 ELSE 1e-9 END ELSE {w} END)", 0)} AS u,
 {_hsql("(CASE WHEN abs({w}) < 1e-9 THEN CASE WHEN {w} < 0 THEN -1e-9 ELSE 1e-9 END ELSE {w} END)", 1)} AS v FROM (SELECT pid, -x AS x, y FROM pts)""")
def _(s):
    u, v = C.homography_xy(H, -F.col("x"), F.col("y"), "sign")
    return s.pts.select("pid", u.alias("u"), v.alias("v"))


@query("pj21_rectified_point", "tile_id:l u:d v:d", f"""
SELECT tile_id, CASE WHEN tile_id % 2 = 0 THEN {_hsql("greatest({w}, 1e-8::DOUBLE)", 0)} ELSE x0 + x END AS u,
 CASE WHEN tile_id % 2 = 0 THEN {_hsql("greatest({w}, 1e-8::DOUBLE)", 1)} ELSE y0 + y END AS v FROM (SELECT *, w / 3 AS x, h / 4 AS y FROM tiles)""")
def _(s):
    t = s.tiles.withColumns({"x": F.col("w") / 3, "y": F.col("h") / 4})
    u, v = C.homography_xy(H, F.col("x"), F.col("y"))
    even = F.col("tile_id") % 2 == 0
    return t.select("tile_id", F.when(even, u).otherwise(F.col("x0") + F.col("x")).alias("u"), F.when(even, v).otherwise(F.col("y0") + F.col("y")).alias("v"))


@query("pj22_aligned_to_mask", "pid:l u:d v:d", """
SELECT pid, ((x - 3 - 100) / 1.05::DOUBLE + 100 - 7) / 0.5 AS u, ((y + 2 - 75) / 1.05::DOUBLE + 75 - 4) / 0.5 AS v FROM pts""")
def _(s):
    u, v = geometry.from_aligned(F.col("x"), F.col("y"), lit(1.05), lit(3), lit(-2), 201, 150, lit(7), lit(4), lit(0.5))
    return s.pts.select("pid", u.alias("u"), v.alias("v"))


@query("pj23_aligned_to_original", "pid:l u:d v:d", "SELECT pid, (149 - y) / 2 AS u, (200 - x) / 2 AS v FROM pts")
def _(s):
    x, y = C.unorient_oriented_by(F.lit(7), F.col("x"), F.col("y"), F.lit(201), F.lit(150))
    return s.pts.select("pid", (x / 2).alias("u"), (y / 2).alias("v"))


@query("pj24_inverse_affine", "pid:l u:d v:d", "SELECT pid, (x - 12) / 1.25::DOUBLE AS u, (y + 4) / 1.25::DOUBLE AS v FROM pts")
def _(s):
    return s.pts.select("pid", ((F.col("x") - 12) / lit(1.25)).alias("u"), ((F.col("y") + 4) / lit(1.25)).alias("v"))


@query("pj25_boxes", "pid:l x0:d y0:d w:d h:d", "SELECT pid, x - 20 AS x0, y - 20 AS y0, 40 AS w, 40 AS h FROM pts")
def _(s):
    return geometry.boxes(s.pts, 40)


@query("pj26_box_forms", "tile_id:l x0:d y0:d w:d h:d", "SELECT * FROM tiles")
def _(s):
    t = s.tiles
    named = F.when(F.col("tile_id") % 2 == 0, F.struct("x0", "y0", "w", "h"))
    plain = F.when(F.col("tile_id") % 2 == 1, F.array("x0", "y0", "w", "h"))
    forms = t.select("tile_id", named.alias("d"), plain.alias("a"))
    return forms.select("tile_id", *[F.coalesce(f"d.{c}", F.col("a")[i]).alias(c) for i, c in enumerate(("x0", "y0", "w", "h"))])


@query("pj27_extraction_level", "pid:l level:l", "SELECT pid, greatest(1, least(6, 5 - CAST(round_even(log2((pid + 3) / 50), 0) AS BIGINT))) AS level FROM pts")
def _(s):
    return s.pts.select("pid", geometry.extraction_level(F.lit(5), (F.col("pid") + 3).cast("double")).alias("level"))


@query("pj28_patch_level", "image:l level:l patch:l", "SELECT image, level, greatest(0, level - 1) AS patch FROM levels")
def _(s):
    return s.levels.withColumn("patch", geometry.patch_level(F.col("level")))


@query("pj29_patch_length", "pid:l n:l", """
SELECT pid, n + n % 2 AS n FROM (SELECT pid, CAST(ceil((pid + 10) * (greatest(sqrt(1.02::DOUBLE * 1.02 + 0.03 * 0.03), sqrt(0.02::DOUBLE * 0.02 + 0.98 * 0.98)) * 0.5 * 1.1)) AS BIGINT) AS n FROM pts)""")
def _(s):
    return s.pts.select("pid", geometry.patch_length((F.col("pid") + 10).cast("double"), ANCHOR_MAP, 1, 2).alias("n"))


@query("pj30_scale_range", "pid:l lo:d hi:d", "SELECT pid, greatest(0.5, pid / 100 * 0.9) AS lo, least(3, pid / 100 * 1.1) AS hi FROM pts")
def _(s):
    lo, hi = geometry.scale_range(F.col("pid") / 100, 0.1)
    return s.pts.select("pid", lo.alias("lo"), hi.alias("hi"))


@query("pj31_fit_and_pad", "tile_id:l scale:d nw:l nh:l px:l py:l", """
SELECT tile_id, scale, nw, nh, floor((64 - nw) / 2) AS px, floor((48 - nh) / 2) AS py FROM
 (SELECT tile_id, s AS scale, greatest(1, floor(w * s)) AS nw, greatest(1, floor(h * s)) AS nh FROM (SELECT *, least(64 / w, 48 / h) AS s FROM tiles))""")
def _(s):
    return s.tiles.select("tile_id", *[c.alias(k) for k, c in geometry.fit_and_pad(F.col("w"), F.col("h"), 64, 48).items()])


@query("pj32_centre_crop", "tile_id:l y:l x:l v:l", "SELECT tile_id, y - 2 AS y, x - 1 AS x, v FROM px WHERE y - 2 BETWEEN 0 AND 3 AND x - 1 BETWEEN 0 AND 5")
def _(s):
    moved = s.px.select("tile_id", (F.col("y") - 2).alias("y"), (F.col("x") - 1).alias("x"), "v")
    return moved.where("y between 0 and 3 and x between 0 and 5")


_WARP = """SELECT {key}, g.scale, g.tx, g.ty, yd AS y, xd AS x FROM {side} m
JOIN (SELECT *, floor((yd - ty - 4) / scale + 4 + 0.5) AS sy, floor((xd - tx - 4) / scale + 4 + 0.5) AS sx
  FROM ({grid}), (SELECT unnest(range(0, 8)) AS yd), (SELECT unnest(range(0, 8)) AS xd)) g ON m.y = g.sy AND m.x = g.sx WHERE m.fg = 1"""
_GRID1 = "SELECT 1.25::DOUBLE AS scale, 1 AS tx, -2 AS ty"


@query("pj33_warp", "pair_id:l y:l x:l", f"SELECT pair_id, y, x FROM ({_WARP.format(key='m.pair_id', side='mb', grid=_GRID1)})")
def _(s):
    return search.warp(s.mb, search.search_grid(s.spark, [1.25], [1], [-2]), 8, 8)


@query("pj34_decimate", "tile_id:l y:l x:l v:l", """
SELECT tile_id, yd AS y, xd AS x, v FROM px JOIN (SELECT unnest(range(0, 2)) AS yd) ON y = floor(yd * 8 / 2) JOIN (SELECT unnest(range(0, 2)) AS xd) ON x = floor(xd * 8 / 2)""")
def _(s):
    return raster.decimate(s.px, 3, 8, 8)


_INV = C.inverse3(((1.1, 0.1, 0.5), (-0.05, 0.95, 0.3), (0.01, 0.005, 1.0)))


@query("pj35_warp_mask", "tile_id:l y:l x:l", f"""
SELECT tile_id, yd AS y, xd AS x FROM pm JOIN (SELECT yd, xd,
 floor(({_INV[0][0]!r}::DOUBLE * xd + {_INV[0][1]!r}::DOUBLE * yd + {_INV[0][2]!r}) / w + 0.5) AS sx, floor(({_INV[1][0]!r}::DOUBLE * xd + {_INV[1][1]!r}::DOUBLE * yd + {_INV[1][2]!r}) / w + 0.5) AS sy
 FROM (SELECT yd, xd, {_INV[2][0]!r}::DOUBLE * xd + {_INV[2][1]!r}::DOUBLE * yd + {_INV[2][2]!r} AS w FROM (SELECT unnest(range(0, 8)) AS yd), (SELECT unnest(range(0, 8)) AS xd))) g
ON pm.x = g.sx AND pm.y = g.sy WHERE fg = 1""")
def _(s):
    dst = s.spark.range(64).select(F.floor(F.col("id") / 8).alias("yd"), (F.col("id") % 8).alias("xd"))
    u, v = C.homography_xy(_INV, F.col("xd"), F.col("yd"), "sign")
    plan = dst.select("yd", "xd", F.floor(u + lit(0.5)).alias("x"), F.floor(v + lit(0.5)).alias("y"))
    fg = s.pm.where("fg = 1").select("tile_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return fg.join(F.broadcast(plan), ["y", "x"]).select("tile_id", F.col("yd").alias("y"), F.col("xd").alias("x"))


@query("pj36_composite", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, trunc(v * (1 - 0.4::DOUBLE) + 255 * fg * 0.4::DOUBLE) AS v FROM pm")
def _(s):
    return s.pm.withColumn("v", raster.composite(F.col("v"), 255 * F.col("fg"), lit(0.4)))


@query("pj37_blend", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, least(255, round_even(0.7::DOUBLE * r + 0.8::DOUBLE * b, 0)) AS v FROM rgb")
def _(s):
    return s.rgb.withColumn("v", raster.blend(F.col("r"), F.col("b")))


@query("pj38_spline_field", "y:l x:l u:d v:d", f"""
SELECT gy AS y, gx AS x, ({_spline_sql(0)}) / 100 AS u, ({_spline_sql(1)}) / 100 AS v FROM (SELECT *, gx * 100.0::DOUBLE AS x, gy * 100.0::DOUBLE AS y
 FROM (SELECT unnest(range(0, 30)) AS gx), (SELECT unnest(range(0, 9)) AS gy))""")
def _(s):
    grid = s.spark.range(270).select((F.col("id") % 30).alias("x"), F.floor(F.col("id") / 30).alias("y"))
    u, v = fitting.spline_xy(_SPLINE, F.col("x") * lit(100), F.col("y") * lit(100))
    return grid.select("y", "x", (u / 100).alias("u"), (v / 100).alias("v"))


def four_corner_maps(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective maps that take four corners (rows, 4, 2) to four places, from eight equations each."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    a = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y], -1), np.stack([z, z, z, x, y, o, -v * x, -v * y], -1)], axis=1)
    m = np.linalg.solve(a, np.concatenate([u, v], axis=1)[..., None])[..., 0]
    return np.concatenate([m, np.ones((len(m), 1))], axis=1).reshape(-1, 3, 3)


@query("pj39_corner_homography", "tile_id:l u:d v:d", f"""
SELECT tile_id, {_hsql("{w}", 0)} AS u, {_hsql("{w}", 1)} AS v FROM (SELECT tile_id, x0 + w * 0.25::DOUBLE AS x, y0 + h * 0.75::DOUBLE AS y FROM tiles)""")
def _(s):
    import pandas as pd

    q = geometry.quads(s.tiles, H)

    def run(batches):
        # the map from a tile's own corners to its quad takes an inner point to where the quad's map takes it
        for pdf in batches:
            size = pdf[["w", "h"]].to_numpy()[:, None]
            to = np.stack([pdf[[f"qx{i}", f"qy{i}"]].to_numpy() for i in range(4)], axis=1)
            m = four_corner_maps(size * np.array(geometry.CORNERS, float), to)
            got = np.einsum("nij,nj->ni", m, np.c_[size[:, 0] * [0.25, 0.75], np.ones(len(pdf))])
            yield pd.DataFrame({"tile_id": pdf["tile_id"], "u": got[:, 0] / got[:, 2], "v": got[:, 1] / got[:, 2]})

    return q.mapInPandas(run, "tile_id long, u double, v double")


@query("pj40_normalised_matrix", "i:l v:d", "SELECT i, CASE i WHEN 0 THEN 2.02 WHEN 1 THEN 0.04 WHEN 2 THEN 10 ELSE 0 END / 2 AS v FROM (SELECT unnest([0, 1, 2]) AS i)")
def _(s):
    m = F.array(*[lit(v) for v in (2.02, 0.04, 10.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0)])
    one = s.spark.range(1).select(F.posexplode(F.transform(m, lambda h: h / m[8])).alias("i", "v"))
    return one.where("i < 3")


@query("pj41_drag_scale", "pid:l sx:d sy:d", "SELECT pid, greatest(0.05, (x * 0.8::DOUBLE + y * 0.6::DOUBLE) / 1000) AS sx, greatest(0.05, (-x * 0.6::DOUBLE + y * 0.8::DOUBLE) / 1000) AS sy FROM pts")
def _(s):
    x, y = F.col("x"), F.col("y")
    return s.pts.select("pid", F.greatest(lit(0.05), (x * lit(0.8) + y * lit(0.6)) / 1000).alias("sx"), F.greatest(lit(0.05), (-x * lit(0.6) + y * lit(0.8)) / 1000).alias("sy"))


@query("pj42_manual_reprojection", "tile_id:l nucleus_id:l dapi_x:d he_x:d overridden:b", """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, nucleus_id, kind ORDER BY seq DESC) AS rn FROM overrides) WHERE rn = 1)
SELECT c.tile_id, c.nucleus_id, coalesce(d.x / 2 + 10, dapi_x) AS dapi_x, coalesce(h.x / 2 + 10, he_x) AS he_x, d.x IS NOT NULL OR h.x IS NOT NULL AS overridden
FROM centroids c LEFT JOIN last d ON d.tile_id = c.tile_id AND d.nucleus_id = c.nucleus_id AND d.kind = 'dapi'
LEFT JOIN last h ON h.tile_id = c.tile_id AND h.nucleus_id = c.nucleus_id AND h.kind = 'he'""")
def _(s):
    from ..operators.manual import with_overrides

    moved = s.overrides.withColumns({"x": F.col("x") / 2 + 10, "y": F.col("y") / 2 + 10})
    return with_overrides(s.centroids, moved)


@query("pj43_dot_radius", "tile_id:l r:l big_r:l", "SELECT tile_id, greatest(1, round_even(3 * least(w, h) / 16, 0)) AS r, greatest(1, round_even(3 * greatest(w, h) / 16, 0)) AS big_r FROM tiles")
def _(s):
    return s.tiles.select("tile_id", geometry.dot_radius(F.least("w", "h"), 3, 16).alias("r"), geometry.dot_radius(F.greatest("w", "h"), 3, 16).alias("big_r"))


@query("pj44_any_channel_mask", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, CASE WHEN greatest(r, g, b) > 150 THEN 0 ELSE 255 END AS v FROM rgb")
def _(s):
    return raster.any_channel_mask(s.rgb, 150)


@query("pj45_elapsed", "event_id:l text:s", """
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
 ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS text FROM (SELECT event_id, event_id * 7 AS s FROM events)""")
def _(s):
    return s.table("events").select("event_id", C.elapsed(F.col("event_id") * 7).alias("text"))


@query("pj46_fit_scale", "tile_id:l scale:d", "SELECT tile_id, least(512 / w, 256 / h) AS scale FROM tiles")
def _(s):
    return s.tiles.select("tile_id", raster.replicate_fit(F.col("w"), F.col("h"), 512, 256).alias("scale"))


@query("pj47_winding", "tile_id:l area:d", """
SELECT tile_id, (x0 * (y0 + h / 2) - (x0 + w) * y0 + (x0 + w) * (y0 + h) - (x0 + w / 3) * (y0 + h / 2) + (x0 + w / 3) * y0 - x0 * (y0 + h)) / 2 AS area FROM tiles""")
def _(s):
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return s.tiles.select("tile_id", C.winding([(x0, y0), (x0 + w, y0 + h / 2), (x0 + w / 3, y0 + h)]).alias("area"))


@query("pj47_corner_order", "tile_id:l tl:l tr:l br:l bl:l", """
SELECT tile_id, arg_min(i, (x + y) * 10 + i) AS tl, arg_max(i, (x - y) * 10 - i) AS tr, arg_max(i, (x + y) * 10 - i) AS br, arg_min(i, (x - y) * 10 + i) AS bl
FROM (SELECT tile_id, (i + tile_id) % 4 AS i, CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS x, CASE WHEN i >= 2 THEN h ELSE 0 END AS y FROM tiles, (SELECT unnest(range(0, 4)) AS i)) GROUP BY tile_id""")
def _(s):
    t = s.tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    k = F.col("k")
    c = t.select("tile_id", ((k + F.col("tile_id")) % 4).alias("i"), F.when(k.isin(1, 2), F.col("w")).otherwise(0.0).alias("x"), F.when(k >= 2, F.col("h")).otherwise(0.0).alias("y"))
    return geometry.corner_order(c)


@query("pj48_rectified_size", "tile_id:l w:l h:l", "SELECT tile_id, greatest(2, round_even((w + w * 1.5) / 2, 0)) AS w, greatest(2, round_even((h + sqrt(pow(w * 0.5, 2) + h * h)) / 2, 0)) AS h FROM tiles")
def _(s):
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    a, b = geometry.rectified_size([(x0, y0), (x0 + w, y0), (x0 + w * 1.5, y0 + h), (x0, y0 + h)])
    return s.tiles.select("tile_id", a.alias("w"), b.alias("h"))
