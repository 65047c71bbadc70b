"""Composite queries: masks, searches, fits, cell projection, streams and SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.columns import lit
from ..operators import fitting, geometry, manual, masks, raster, sampling, search
from ..streaming import events as streams
from .adapters import ANCHOR_MAP, META, SIDE
from .projections import _SPLINE, _WARP, _spline_sql, stain_normalise
from .registry import query
from .selections import _CLOSE, _LLOYD, PAIR


@query("it01_valid_coords", "y:l x:l", "SELECT y, x FROM big WHERE v > 140")
def _(s):
    return sampling.valid_coords(s.big.withColumn("fg", (F.col("v") > 140).cast("int")))


@query("it02_poisson_disk", "pid:l x:d y:d")
def _(s):
    return sampling.poisson_disk(s.pts, 60)


@query("it03_repel", "pid:l x:d y:d")
def _(s):
    return sampling.repel(s.spots, s.pts.select("x", "y"), 12)


@query("it04_lloyd_step", "cid:l cx:d cy:d", _LLOYD)
def _(s):
    return sampling.lloyd_step(s.pts, s.centres)


@query("it04_lloyd", "cid:l cx:d cy:d")
def _(s):
    return sampling.lloyd(s.pts, s.centres, 10)


@query("it05_close_pair_repair", "pid:l", f"SELECT DISTINCT j AS pid FROM ({_CLOSE.format(t='pts', r=30)})")
def _(s):
    return masks.close_to_lower(s.pts, 30)


@query("it06_sampling", "tile:l x0:d y0:d w:d h:d")
def _(s):
    h = s.table("embeddings").agg(F.max("vec_id")).first()[0] + 1
    free = masks.available_boundary(s.big.withColumn("fg", (F.col("v") > 110).cast("int")), 3, h, 64)
    points = free.select((F.col("y") * 64 + F.col("x")).alias("pid"), "x", "y")
    start = sampling.poisson_disk(points, 14, n=20).select(F.col("pid").alias("cid"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"))
    moved = sampling.lloyd(points, start, 5)
    return geometry.boxes(moved.select(F.col("cid").alias("tile"), F.col("cx").alias("x"), F.col("cy").alias("y")), 10)


@query("it07_extraction", "tile_id:l cx0:l cy0:l cx1:l cy1:l", """
SELECT tile_id, greatest(0, least(400, round_even(x0, 0))) AS cx0, greatest(0, least(300, round_even(y0, 0))) AS cy0, greatest(0, least(400, round_even(x0 + w, 0))) AS cx1, greatest(0, least(300, round_even(y0 + h, 0))) AS cy1
FROM tiles WHERE greatest(0, least(x0 + w, 400) - greatest(x0, 0)) * greatest(0, least(y0 + h, 300) - greatest(y0, 0)) / (w * h) >= 0.15""")
def _(s):
    kept = geometry.bbox_overlap(s.tiles, 400, 300).where("ratio >= 0.15")
    return geometry.clamped(kept, 400, 300)


@query("it08_pilot", "step:l pid:l")
def _(s):
    return sampling.farthest_points(s.pts, 10)


def dark_nuclei_mask(a: np.ndarray, offset: int = 0, share: float = 1e-4, up: int = 2) -> np.ndarray:
    """Enlarge, threshold by Otsu, fill holes, drop small parts; returned at the enlarged size, objects dark."""
    big = np.repeat(np.repeat(a, up, 0), up, 1)
    n = np.bincount(big.astype(int).reshape(-1), minlength=256).astype(float)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    n1, s1 = n0[-1] - n0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n0 > 0) & (n1 > 0), n0 * n1 * (s0 / n0 - s1 / n1) ** 2, -1)
    t = np.clip(int(np.argmax(score)) + offset, 0, 255)
    fg = masks.fill_holes_image(big > t)
    fg = masks.small_removed(fg, int(share * big.shape[0] ** 2 * up**2))
    return np.where(fg, 0, 255)


@query("it09_nuclei_mask", "tile_id:l y:l x:l v:l")
def _(s):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((SIDE, SIDE))
        a[pdf["y"], pdf["x"]] = pdf["v"]
        m = dark_nuclei_mask(a)
        y, x = np.indices(m.shape)
        return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "y": y.reshape(-1), "x": x.reshape(-1), "v": m.reshape(-1)})

    return s.px.groupBy("tile_id").applyInPandas(run, "tile_id long, y int, x int, v int")


def grey_filter(a: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Largest or smallest value in the disk around each pixel; beyond the edge nothing counts."""
    h, w = a.shape
    far = np.pad(a.astype(float), radius, constant_values=-np.inf if largest else np.inf)
    steps = range(-radius, radius + 1)
    near = [far[radius + dy : radius + dy + h, radius + dx : radius + dx + w] for dy in steps for dx in steps if dy * dy + dx * dx <= radius * radius]
    return (np.max if largest else np.min)(near, axis=0)


def opened(a: np.ndarray, radius: int) -> np.ndarray:
    return grey_filter(grey_filter(a, radius, False), radius, True)


def closed(a: np.ndarray, radius: int) -> np.ndarray:
    return grey_filter(grey_filter(a, radius, True), radius, False)


def histology_mask(rgb: np.ndarray, threshold: float = 0.6, up: int = 2, n: int = 2, min_object: int = 30, max_hole: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Nuclei of a stained tile, enlarged: the mask of the stain above the threshold, and its objects, split.

    The stain's own image (the tile itself where too few pixels absorb) as grey of 0 to 1 is opened
    and closed by a disk, thresholded, rid of small objects and holes, and closed by a cross.
    """
    big = np.repeat(np.repeat(rgb, up, 0), up, 1)
    got = stain_normalise(big)
    grey = (big if got is None else got[1]) @ np.array([0.2125, 0.7154, 0.0721]) / 255
    mask = closed(opened(grey, n), n) > threshold
    mask = masks.small_removed(mask, min_object, 4)
    mask = ~masks.small_removed(~mask, max_hole, 4)
    mask = closed(mask, 1) > 0
    return mask, masks.watershed_image(opened(mask, 1) > 0, min_object, dist_share=0.42, peak_dist=6)


@query("it10_histology_mask", "tile_id:l y:l x:l fg:l label:l")
def _(s):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((SIDE, SIDE, 3))
        a[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]]
        mask, label = histology_mask(a)
        y, x = np.indices(mask.shape).reshape(2, -1)
        return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "y": y, "x": x, "fg": mask.reshape(-1).astype(int), "label": label.reshape(-1)})

    return s.rgb.groupBy("tile_id").applyInPandas(run, "tile_id long, y int, x int, fg int, label int")


_M = "SELECT c.tile_id, c.y, c.x, {f}(n.v) AS v FROM {t} c JOIN {t} n ON n.tile_id = c.tile_id AND abs(n.y - c.y) + abs(n.x - c.x) <= 1 GROUP BY ALL"


@query("it11_smooth", "tile_id:l y:l x:l v:l", f"WITH a AS ({_M.format(f='min', t='px')}), b AS ({_M.format(f='max', t='a')}), c AS ({_M.format(f='max', t='b')}) {_M.format(f='min', t='c').replace('FROM c c', 'FROM c AS c')}")
def _(s):
    return raster.smooth(s.px, 1)


@query("it12_watershed", "tile_id:l y:l x:l label:l")
def _(s):
    return masks.per_image(s.pm, lambda a: masks.watershed_image(a > 0, 2), "label")


@query("it13_peak_watershed", "tile_id:l y:l x:l label:l")
def _(s):
    return masks.per_image(s.pm, lambda a: masks.watershed_image(a > 0, 1, dist_share=0.99, peak_dist=0), "label")


@query("it14_contours", "tile_id:l y:l x:l", """
SELECT c.tile_id, c.y, c.x FROM pm c JOIN pm n ON n.tile_id = c.tile_id AND abs(n.y - c.y) + abs(n.x - c.x) <= 1 WHERE c.fg = 1 GROUP BY ALL HAVING min(n.fg) = 0""")
def _(s):
    return raster.boundary(s.pm.select("tile_id", "y", "x", F.col("fg").alias("v")))


def _blobs(s, mask):
    lab = masks.components(mask)
    stats = masks.component_stats(lab)
    clustered = masks.clusters(stats, 2.5)
    best = masks.top_clusters(clustered, 3)
    chosen = clustered.join(best.select("tile_id", "cluster"), ["tile_id", "cluster"], "left_semi").select("tile_id", "label")
    return lab.join(chosen, ["tile_id", "label"], "left_semi").select("tile_id", "y", "x")


@query("it15_dot_blobs", "tile_id:l y:l x:l")
def _(s):
    closed = raster.closing(s.pm.select("tile_id", "y", "x", F.col("fg").alias("v")), raster.disk(1))
    return _blobs(s, closed.withColumnRenamed("v", "fg"))


@query("it16_lut_blobs", "tile_id:l y:l x:l")
def _(s):
    return _blobs(s, s.rgb.withColumn("fg", (raster.grey_u8(F.col("b"), F.col("g"), F.col("r")) > 110).cast("int")))


@query("it17_clean_and_cluster", "tile_id:l y:l x:l")
def _(s):
    filled = masks.per_image(s.pm, lambda a: masks.fill_holes_image(a > 0, 0.1, 0.2), "fg")
    opened = raster.opening(filled.select("tile_id", "y", "x", F.col("fg").alias("v")), raster.disk(1))
    return _blobs(s, opened.withColumnRenamed("v", "fg"))


@query("it18_threshold_update", "t:l n:l", "SELECT t, count(*) FILTER (WHERE v > t) AS n FROM px, (SELECT unnest(range(100, 200, 20)) AS t) GROUP BY t")
def _(s):
    t = F.explode(F.array(*[F.lit(i) for i in range(100, 200, 20)]))
    return s.px.groupBy("v").agg(F.count("*").alias("k")).withColumn("t", t).groupBy("t").agg(F.sum(F.when(F.col("v") > F.col("t"), F.col("k")).otherwise(0)).alias("n"))


_SCALES = (0.9, 1.0, 1.1)
_GRID = "SELECT scale, tx, ty FROM (SELECT unnest([0.9::DOUBLE, 1.0::DOUBLE, 1.1::DOUBLE]) AS scale), (SELECT unnest(range(-2, 3)) AS tx), (SELECT unnest(range(-2, 3)) AS ty)"
_SCALED = _WARP.format(key="m.pair_id", side="mb", grid="SELECT unnest([0.9::DOUBLE, 1.0::DOUBLE, 1.1::DOUBLE]) AS scale, 0 AS tx, 0 AS ty")


def _score_sql(moved: str, grid: str, where: str = "TRUE") -> str:
    return f"""SELECT k.pair_id, k.scale, k.tx, k.ty, 2 * coalesce(ab, 0) / (na + coalesce(nb, 0) + 1e-6::DOUBLE) AS score
FROM (SELECT pair_id, na, scale, tx, ty FROM (SELECT pair_id, sum(fg) AS na FROM ma WHERE {where} GROUP BY pair_id), ({grid})) k
LEFT JOIN (SELECT m.pair_id, scale, tx, ty, count(*) AS nb, count(a.pair_id) AS ab FROM ({moved}) m LEFT JOIN (SELECT * FROM ma WHERE fg = 1) a ON a.pair_id = m.pair_id AND a.y = m.y AND a.x = m.x GROUP BY ALL) v
 ON v.pair_id = k.pair_id AND v.scale = k.scale AND v.tx = k.tx AND v.ty = k.ty"""


_COARSE = _score_sql(
    f"SELECT pair_id, w.scale, g.tx, g.ty, y + g.ty AS y, x + g.tx AS x FROM ({_SCALED}) w JOIN ({_GRID}) g ON g.scale = w.scale WHERE y + g.ty BETWEEN 0 AND 7 AND x + g.tx BETWEEN 0 AND 7",
    _GRID,
)
_BEST = "SELECT pair_id, scale, tx, ty, score FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, scale, tx, ty) AS rn FROM ({})) WHERE rn = 1"


def _coarse(s):
    grid = search.search_grid(s.spark, _SCALES, range(-2, 3), range(-2, 3))
    return search.grid_scores(s.ma, s.mb, grid, SIDE, SIDE)


@query("it19_median_scale", "scale:d", f"SELECT median(scale) AS scale FROM (SELECT scale FROM ({_BEST.format(_COARSE)}) ORDER BY pair_id LIMIT 15)")
def _(s):
    return search.median_scale(search.best_alignment(_coarse(s)), 15)


@query("it20_coarse_search", "pair_id:l scale:d tx:l ty:l score:d", _BEST.format(_COARSE))
def _(s):
    return search.best_alignment(_coarse(s))


@query("it21_fine_search", "pair_id:l scale:d tx:l ty:l score:d", _BEST.format(_score_sql(
    "SELECT pair_id, w.scale, g.tx, g.ty, y + g.ty AS y, x + g.tx AS x FROM (" + _WARP.format(key="m.pair_id", side="mb", grid="SELECT unnest([0.98::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE, 1.01::DOUBLE, 1.02::DOUBLE]) AS scale, 0 AS tx, 0 AS ty")
    + ") w, (SELECT tx, ty FROM (SELECT unnest(range(-1, 2)) AS tx), (SELECT unnest(range(-1, 2)) AS ty)) g WHERE y + g.ty BETWEEN 0 AND 7 AND x + g.tx BETWEEN 0 AND 7",
    "SELECT scale, tx, ty FROM (SELECT unnest([0.98::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE, 1.01::DOUBLE, 1.02::DOUBLE]) AS scale), (SELECT unnest(range(-1, 2)) AS tx), (SELECT unnest(range(-1, 2)) AS ty)")))
def _(s):
    grid = search.refine_grid(s.spark, 1.0, 0, 0, SIDE, 0.02, 0.01, 0.1, 0.1).withColumn("scale", F.round("scale", 6))
    return search.best_alignment(search.grid_scores(s.ma, s.mb, grid, SIDE, SIDE))


@query("it22_score_params", "pair_id:l score:d", f"SELECT pair_id, score FROM ({_score_sql(_WARP.format(key='m.pair_id', side='mb', grid='SELECT 1.1::DOUBLE AS scale, 1 AS tx, -1 AS ty'), 'SELECT 1.1::DOUBLE AS scale, 1 AS tx, -1 AS ty')})")
def _(s):
    grid = search.search_grid(s.spark, [1.1], [1], [-1])
    return search.grid_scores(s.ma, s.mb, grid, SIDE, SIDE, clip_first=False)


@query("it23_tile_pairs", "pair_id:l rank:l a:l b:l u:d v:d", """
SELECT pair_id, rank, a, b, 7 - (a - 1) % 8 AS u, (b - 1) // 8 / 2 AS v FROM
 (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(f1, 9) DESC, a, b) AS rank FROM pairs WHERE least(cov_a, cov_b) >= 0.4) WHERE rank <= 3""")
def _(s):
    # pair the components of each aligned tile, keep the best, map their places back
    top = masks.top_pairs(masks.overlap_pairs(s.ra, s.rb, 0.4, PAIR), 3, PAIR)
    return top.withColumns({"u": 7 - (F.col("a") - 1) % SIDE, "v": F.floor((F.col("b") - 1) / SIDE) / 2})


@query("it24_anchor_patches", "pid:l px0:l py0:l px1:l py1:l", """
SELECT pid, greatest(0, cx - 16) AS px0, greatest(0, cy - 16) AS py0, least(2000, cx + 16) AS px1, least(2000, cy + 16) AS py1 FROM
 (SELECT pid, greatest(0, least(1999, CAST(round_even(x0 + sx, 0) AS BIGINT))) AS cx, greatest(0, least(1999, CAST(round_even(y0 + sy, 0) AS BIGINT))) AS cy FROM anchors JOIN tiles USING (tile_id))""")
def _(s):
    placed = manual.place_anchors(s.anchors.select("pid", "tile_id", F.col("sx").alias("x"), F.col("sy").alias("y")), s.tiles)
    return placed.withColumns(geometry.patch_box(F.col("gx"), F.col("gy"), 32, 2000, 2000))


@query("it25_patch_masks", "tile_id:l n:l")
def _(s):
    lab = masks.per_image(s.px, lambda a: dark_nuclei_mask(a, up=1) < 128, "fg", value="v")
    return lab.groupBy("tile_id").agg(F.sum("fg").alias("n"))


@query("it26_refined_centres", "tile_id:l x:d y:d status:s", """
SELECT t.tile_id, coalesce(c1.cx, c2.cx, t.x) AS x, coalesce(c1.cy, c2.cy, t.y) AS y, CASE WHEN c1.cx IS NOT NULL THEN 'patch' WHEN c2.cx IS NOT NULL THEN 'tile' ELSE 'original' END AS status
FROM (SELECT DISTINCT tile_id, tile_id % 8 AS x, 3 AS y FROM px) t
LEFT JOIN runs r1 ON r1.tile_id = t.tile_id AND r1.y = t.y AND r1.x = t.x LEFT JOIN comps c1 ON c1.tile_id = r1.tile_id AND c1.label = r1.label AND c1.area >= 2
LEFT JOIN runs r2 ON r2.tile_id = t.tile_id AND r2.y = t.y + 1 AND r2.x = t.x LEFT JOIN comps c2 ON c2.tile_id = r2.tile_id AND c2.label = r2.label""")
def _(s):
    t = s.px.select("tile_id").distinct().withColumns({"x": (F.col("tile_id") % 8).cast("int"), "y": F.lit(3)})
    hit = s.runs.join(s.comps.select("tile_id", "label", "area", "cx", "cy"), ["tile_id", "label"]).select("tile_id", "y", "x", "area", "cx", "cy")
    near = hit.where("area >= 2").select("tile_id", "y", "x", F.col("cx").alias("c1x"), F.col("cy").alias("c1y"))
    wide = hit.select("tile_id", (F.col("y") - 1).alias("y"), "x", F.col("cx").alias("c2x"), F.col("cy").alias("c2y"))
    both = t.join(near, ["tile_id", "y", "x"], "left").join(wide, ["tile_id", "y", "x"], "left")
    status = F.when(F.col("c1x").isNotNull(), "patch").when(F.col("c2x").isNotNull(), "tile").otherwise("original")
    return both.select("tile_id", F.coalesce("c1x", "c2x", "x").alias("x"), F.coalesce("c1y", "c2y", "y").alias("y"), status.alias("status"))


def _fit_rows(s, m, scored):
    rows = [(i, j, float(m[i][j])) for i in range(len(m)) for j in range(3)]
    n = scored.agg(F.count_if("inlier").alias("n"))
    return s.spark.createDataFrame(rows, "i int, j int, v double").crossJoin(F.broadcast(n))


def _lsq_sql(where: str) -> str:
    """Both rows of the least-squares affine over some anchors, by Cramer's rule, and how many anchors they are."""
    c = "{k}x * (yy * n - y * y) - xy * ({k}y * n - y * {k}) + x * ({k}y * y - yy * {k})", "xx * ({k}y * n - y * {k}) - {k}x * (xy * n - y * x) + x * (xy * {k} - {k}y * x)", "xx * (yy * {k} - {k}y * y) - xy * (xy * {k} - {k}y * x) + {k}x * (xy * y - yy * x)"
    rows = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, ({e.format(k='uv'[i])}) / det AS v, n FROM d" for i in (0, 1) for j, e in enumerate(c))
    return f"""WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(sx) AS x, sum(sy) AS y, sum(sx * sx) AS xx, sum(sx * sy) AS xy, sum(sy * sy) AS yy,
 sum(dx) AS u, sum(sx * dx) AS ux, sum(sy * dx) AS uy, sum(dy) AS v, sum(sx * dy) AS vx, sum(sy * dy) AS vy FROM anchors WHERE {where}),
d AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s) {rows}"""


# the anchors' noise is below 4 pixels but for every eleventh, which is 500 off: the inliers are known
@query("it27_ransac_affine", "i:l j:l v:d n:l", _lsq_sql("pid % 11 <> 0"))
def _(s):
    return _fit_rows(s, *fitting.ransac(s.anchors, "affine"))


@query("it27_hypothesis_scores", "h:l n:l", """
SELECT h, count(*) FILTER (WHERE sqrt(pow((1.02::DOUBLE + h * 0.01::DOUBLE) * sx - 0.03::DOUBLE * sy + 40 - dx, 2) + pow(0.02::DOUBLE * sx + 0.98::DOUBLE * sy - 25 - dy, 2)) <= 8) AS n
FROM anchors, (SELECT unnest(range(0, 5)) AS h) GROUP BY h""")
def _(s):
    px = (lit(1.02) + F.col("h") * lit(0.01)) * F.col("sx") - lit(0.03) * F.col("sy") + 40
    py = lit(0.02) * F.col("sx") + lit(0.98) * F.col("sy") - 25
    rows = s.anchors.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.groupBy("h").agg(F.count_if(F.hypot(px - F.col("dx"), py - F.col("dy")) <= 8).alias("n"))


@query("it28_ransac_homography", "i:l j:l v:d n:l")
def _(s):
    return _fit_rows(s, *fitting.ransac(s.anchors, "homography"))


@query("it29_blob_affine", "i:l j:l v:d n:l")
def _(s):
    return _fit_rows(s, *fitting.ransac(s.anchors.where("pid % 3 = 0"), "affine", threshold=3.0))


_LSQ = """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(sx) AS x, sum(sy) AS y, sum(sx * sx) AS xx, sum(sx * sy) AS xy, sum(sy * sy) AS yy, sum(dx) AS u, sum(sx * dx) AS xu, sum(sy * dx) AS yu FROM anchors WHERE pid % 11 <> 0),
d AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s)
SELECT (xu * (yy * n - y * y) - xy * (yu * n - y * u) + x * (yu * y - yy * u)) / det AS a, (xx * (yu * n - y * u) - xu * (xy * n - y * x) + x * (xy * u - yu * x)) / det AS b,
 (xx * (yy * u - yu * y) - xy * (xy * u - yu * x) + xu * (xy * y - yy * x)) / det AS c FROM d"""


@query("it30_affine_lsq", "a:d b:d c:d", _LSQ)
def _(s):
    m = fitting.affine_fit(s.anchors.where("pid % 11 <> 0"))
    return s.spark.createDataFrame([tuple(m[0])], "a double, b double, c double")


_CONTROLS = "SELECT gx, gy, avg(sx) AS sx, avg(sy) AS sy, avg(dx) AS dx, avg(dy) AS dy FROM (SELECT *, floor(sx / 300) AS gx, floor(sy / 300) AS gy FROM anchors WHERE pid % 11 <> 0) GROUP BY gx, gy"


@query("it31_spline_fit", "gx:l gy:l dx:d dy:d", f"SELECT gx, gy, dx, dy FROM ({_CONTROLS})")
def _(s):
    # the fit's equations: at a control point, the spline and its weight times the regulariser give the target
    controls = fitting.control_pairs(s.anchors.where("pid % 11 <> 0"), 300)
    m = fitting.spline_from(controls, 1e-2)
    ctrl = s.spark.createDataFrame([(*map(float, c), *map(float, w)) for c, w in zip(m["ctrl"], m["w"], strict=True)], "x double, y double, wx double, wy double")
    u, v = fitting.spline_xy(m, F.col("x"), F.col("y"))
    return ctrl.select(F.floor(F.col("x") / 300).alias("gx"), F.floor(F.col("y") / 300).alias("gy"), (u + lit(1e-2) * F.col("wx")).alias("dx"), (v + lit(1e-2) * F.col("wy")).alias("dy"))


@query("it32_spline_apply", "pid:l u:d v:d", f"SELECT pid, {_spline_sql(0)} AS u, {_spline_sql(1)} AS v FROM (SELECT pid, sx AS x, sy AS y FROM anchors)")
def _(s):
    u, v = fitting.spline_xy(_SPLINE, F.col("sx"), F.col("sy"))
    return s.anchors.select("pid", u.alias("u"), v.alias("v"))


@query("it33_estimate", "num_points:l num_inliers:l mean_error:d median_error:d", f"""
WITH m AS ({_lsq_sql("pid % 11 <> 0")}), t AS (SELECT max(v) FILTER (WHERE i = 0 AND j = 0) AS a, max(v) FILTER (WHERE i = 0 AND j = 1) AS b, max(v) FILTER (WHERE i = 0 AND j = 2) AS c,
 max(v) FILTER (WHERE i = 1 AND j = 0) AS d, max(v) FILTER (WHERE i = 1 AND j = 1) AS e, max(v) FILTER (WHERE i = 1 AND j = 2) AS f FROM m),
r AS (SELECT sqrt(pow(a * sx + b * sy + c - dx, 2) + pow(d * sx + e * sy + f - dy, 2)) AS error FROM anchors, t)
SELECT count(*) AS num_points, count(*) FILTER (WHERE error <= 8) AS num_inliers, avg(error) FILTER (WHERE error <= 8) AS mean_error, median(error) FILTER (WHERE error <= 8) AS median_error FROM r""")
def _(s):
    m, _ = fitting.ransac(s.anchors, "affine")
    return fitting.inlier_summary(s.anchors, m)


_CELL_SQL = """SELECT cell_id, kind, (1.01::DOUBLE * mx + 0.02::DOUBLE * my + 5) / greatest(0.00001::DOUBLE * mx + 0.00002::DOUBLE * my + 1, 1e-8::DOUBLE) AS x_image,
 (-0.015::DOUBLE * mx + 0.99::DOUBLE * my + 3) / greatest(0.00001::DOUBLE * mx + 0.00002::DOUBLE * my + 1, 1e-8::DOUBLE) AS y_image
FROM (SELECT *, x_centroid / 0.2125::DOUBLE + 100 AS mx, y_centroid / 0.2125::DOUBLE + 50 AS my FROM cells)"""


@query("it34_cells_to_he", "cell_id:l kind:s x_image:d y_image:d", _CELL_SQL)
def _(s):
    from .adapters import HOMOGRAPHY

    return fitting.project_cells(s.cells, META, {"transform_type": "homography", "matrix": HOMOGRAPHY})


@query("it34_cells_affine", "cell_id:l x_image:d y_image:d", """
SELECT cell_id, 1.02::DOUBLE * mx - 0.03::DOUBLE * my + 40 AS x_image, 0.02::DOUBLE * mx + 0.98::DOUBLE * my - 25 AS y_image
FROM (SELECT *, x_centroid / 0.2125::DOUBLE + 100 AS mx, y_centroid / 0.2125::DOUBLE + 50 AS my FROM cells)""")
def _(s):
    return fitting.project_cells(s.cells, META, {"matrix": ANCHOR_MAP})


@query("it35_viewer_points", "pid:l u:d v:d inlier:b", """
SELECT pid, u / 4 AS u, v / 4 AS v, sqrt(pow(u - dx, 2) + pow(v - dy, 2)) <= 8 AS inlier FROM (SELECT *, 1.02::DOUBLE * sx - 0.03::DOUBLE * sy + 40 AS u, 0.02::DOUBLE * sx + 0.98::DOUBLE * sy - 25 AS v FROM anchors)""")
def _(s):
    from ..functions.columns import affine_xy

    u, v = affine_xy(ANCHOR_MAP, F.col("sx"), F.col("sy"))
    return s.anchors.select("pid", (u / 4).alias("u"), (v / 4).alias("v"), (F.hypot(u - F.col("dx"), v - F.col("dy")) <= 8).alias("inlier"))


@query("ss01_progress", "stage:s done:l total:l pct:d", """
SELECT stage, done, total, done * 100.0 / total AS pct FROM (SELECT event_type AS stage, event_id % 50 AS done, 50 AS total, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 4 <> 0) WHERE rn = 1""")
def _(s):
    e = s.table("events")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("[INFO] "), "event_type")).otherwise(F.format_string("[PROGRESS] %s %d/50", "event_type", F.col("event_id") % 50))
    return streams.last_progress(streams.progress(e.select(F.col("event_id").alias("seq"), line.alias("line"))))


@query("ss02_hourly_counts", "start:t event_type:s n:l", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s):
    return streams.hourly_counts(s.table("events"))


@query("ss02_sessions", "user_id:l start:t n:l", """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")
def _(s):
    return streams.sessions(s.table("events"))


@query("ss02_durations", "event_id:l seconds:d", "SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS seconds FROM events")
def _(s):
    return streams.durations(s.table("events"), "user_id")


@query("ss03_queue_polls", "poll:l n:l last:l", "SELECT epoch_us(ts) // 100000 AS poll, count(*) AS n, arg_max(event_id, ts) AS last FROM events GROUP BY poll")
def _(s):
    return streams.polls(s.table("events"))


@query("ss04_ready_stages", "user_id:l ready:b", "SELECT user_id, bool_or(event_type = 'click') AND bool_or(event_type = 'view') AS ready FROM events GROUP BY user_id")
def _(s):
    return s.table("events").groupBy("user_id").agg((F.bool_or(F.col("event_type") == "click") & F.bool_or(F.col("event_type") == "view")).alias("ready"))


@query("fn_sql_point_maps", "pid:l ax:d hy:d", """
SELECT pid, 1.02::DOUBLE * x - 0.03::DOUBLE * y + 40 AS ax, (-0.015::DOUBLE * x + 0.99::DOUBLE * y + 3) / greatest(0.00001::DOUBLE * x + 0.00002::DOUBLE * y + 1, 1e-8::DOUBLE) AS hy FROM pts""")
def _(s):
    from ..functions.registered import register
    from .adapters import HOMOGRAPHY

    register(s.spark)
    s.pts.createOrReplaceTempView("_points")
    a, h = (", ".join(f"{float(v)!r}D" for r in m for v in r) for m in (ANCHOR_MAP, HOMOGRAPHY))
    return s.spark.sql(f"SELECT pid, img_affine_x(array({a}), x, y) AS ax, img_homography_y(array({h}), x, y) AS hy FROM _points")


@query("fn_otsu_aggregate", "tile_id:l threshold:l", """SELECT tile_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, v) AS rn FROM (SELECT tile_id, v,
 round_even(coalesce(n0 * n1 * pow(s0 / n0 - s1 / nullif(n1, 0), 2), 0), 6) AS score FROM (SELECT tile_id, v, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n * v) OVER w AS DOUBLE) AS s0,
 CAST(sum(n) OVER (PARTITION BY tile_id) - sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * v) OVER (PARTITION BY tile_id) - sum(n * v) OVER w AS DOUBLE) AS s1
 FROM (SELECT tile_id, v, count(*) AS n FROM px GROUP BY ALL) WINDOW w AS (PARTITION BY tile_id ORDER BY v)))) WHERE rn = 1""")
def _(s):
    from ..functions.registered import otsu_threshold

    return s.px.groupBy("tile_id").agg(otsu_threshold("v").alias("threshold"))


@query("fn_tile_grid", "tile_id:l x0:l y0:l w:l h:l", "SELECT i * 5 + j AS tile_id, j * 1024 AS x0, i * 1024 AS y0, least(1024, 4500 - j * 1024) AS w, least(1024, 3500 - i * 1024) AS h FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 5)) AS j)")
def _(s):
    from ..functions.registered import register

    register(s.spark)
    return s.spark.sql("SELECT * FROM tile_grid(4500, 3500, 1024)")
