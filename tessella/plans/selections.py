"""Filter, join, aggregate, ordered, set and edit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import lit
from ..operators import fitting, geometry, manual, masks, raster, sampling
from .adapters import ANCHOR_MAP, HOMOGRAPHY, SIDE
from .registry import query

PAIR = ("pair_id",)
_DISK1 = "abs(n.y - c.y) + abs(n.x - c.x) <= 1"


@query("fl01_percentile_mask", "tile_id:l y:l x:l fg:l", """
SELECT tile_id, y, x, CAST(v > coalesce(t, 1000) AS INTEGER) AS fg FROM px LEFT JOIN (SELECT tile_id, trunc(quantile_cont(v, 0.45)) AS t FROM px WHERE v > 0 GROUP BY tile_id) USING (tile_id)""")
def _(s):
    return masks.threshold_mask(s.px)


@query("fl01_fixed_mask", "tile_id:l y:l x:l fg:l", "SELECT tile_id, y, x, CAST(v > 130 AS INTEGER) AS fg FROM px")
def _(s):
    return masks.threshold_mask(s.px, "fixed", fixed=130)


_DENSE = "SELECT tile_id, y, x FROM pm JOIN (SELECT tile_id, quantile_cont(v, 0.4) AS t FROM pm WHERE fg = 1 GROUP BY tile_id) USING (tile_id) WHERE fg = 1 AND v >= t"


@query("fl02_density_filter", "tile_id:l y:l x:l", _DENSE)
def _(s):
    return masks.dense_pixels(s.pm)


@query("fl03_nonvoid_dense", "tile_id:l y:l x:l", f"""
SELECT d.* FROM ({_DENSE}) d JOIN (SELECT c.tile_id, c.y, c.x FROM px c JOIN px n ON n.tile_id = c.tile_id AND {_DISK1} GROUP BY ALL HAVING min(n.v) > 100) USING (tile_id, y, x)""")
def _(s):
    return masks.valid_and_dense(s.pm.withColumn("v", F.greatest(F.lit(0), F.col("v") - 100)))


_AVAILABLE = f"""SELECT c.tile_id, c.y, c.x FROM pm c JOIN pm n ON n.tile_id = c.tile_id AND {_DISK1}
WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY ALL HAVING min(n.fg) = 1"""


@query("fl04_available", "tile_id:l y:l x:l", _AVAILABLE)
def _(s):
    return masks.available(s.pm, 1, SIDE, SIDE)


@query("fl04_stored_availability", "tile_id:l y:l x:l v:l", f"SELECT px.tile_id, px.y, px.x, CASE WHEN a.x IS NULL THEN 255 ELSE 0 END AS v FROM px LEFT JOIN ({_AVAILABLE}) a USING (tile_id, y, x)")
def _(s):
    return masks.stored_availability(masks.available(s.pm, 1, SIDE, SIDE), s.px)


@query("fl05_boundary_available", "tile_id:l y:l x:l", "SELECT tile_id, y, x FROM pm WHERE fg = 1 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def _(s):
    return masks.available_boundary(s.pm, 2, SIDE, SIDE)


@query("fl06_distance_available", "tile_id:l y:l x:l d:l", """
SELECT c.tile_id, c.y, c.x, coalesce(min(pow(n.y - c.y, 2) + pow(n.x - c.x, 2)), 9999) AS d FROM pm c LEFT JOIN pm n ON n.tile_id = c.tile_id AND n.fg = 0
WHERE c.fg = 1 GROUP BY ALL HAVING coalesce(min(pow(n.y - c.y, 2) + pow(n.x - c.x, 2)), 9999) >= 4""")
def _(s):
    d = masks.per_image(s.pm, lambda a: (masks.chamfer(a > 0) ** 2).round(), "d")
    return d.where("d >= 4")


@query("fl07_prune_boxes", "tile_id:l ratio:d", """
SELECT tile_id, ratio FROM (SELECT tile_id, greatest(0, least(x0 + w, 400) - greatest(x0, 0)) * greatest(0, least(y0 + h, 300) - greatest(y0, 0)) / (w * h) AS ratio FROM tiles WHERE w * h > 0) WHERE ratio >= 0.15""")
def _(s):
    return geometry.bbox_overlap(s.tiles, 400, 300).where("ratio >= 0.15")


@query("fl07_prune_quads", "tile_id:l ratio:d")
def _(s):
    return geometry.prune_outside(s.tiles, HOMOGRAPHY, 400, 300)


@query("fl08_dark_threshold", "tile_id:l y:l x:l fg:l", "SELECT tile_id, y, x, CAST((0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b) / 255 > 0.5 AS INTEGER) AS fg FROM rgb")
def _(s):
    return s.rgb.withColumn("fg", (raster.luminance(F.col("r"), F.col("g"), F.col("b")) / 255 > 0.5).cast("int"))


@query("fl09_min_area", "tile_id:l y:l x:l label:l", "SELECT tile_id, y, x, label FROM runs JOIN (SELECT tile_id, label FROM comps WHERE area >= 2) USING (tile_id, label)")
def _(s):
    return masks.large_components(s.runs, 2)


@query("fl10_fill_holes", "tile_id:l y:l x:l fg:l")
def _(s):
    return masks.per_image(s.pm, lambda a: masks.fill_holes_image(a > 0, 0.1, 0.2), "fg")


_ISO = """SELECT c.* FROM comps c JOIN (SELECT tile_id, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.75) AS q3 FROM comps
 WHERE cx BETWEEN 8 / 6 AND 40 / 6 AND cy BETWEEN 8 / 6 AND 40 / 6 GROUP BY tile_id) q USING (tile_id)
 WHERE cx BETWEEN 8 / 6 AND 40 / 6 AND cy BETWEEN 8 / 6 AND 40 / 6 AND area <= q3 + 1.5 * (q3 - q1)"""


@query("fl11_isolated", "tile_id:l label:l area:l cx:d cy:d", _ISO)
def _(s):
    return masks.isolated(s.comps, SIDE, SIDE, min_area=1)


@query("fl12_touching", "tile_id:l label:l", "SELECT DISTINCT c.tile_id, c.label FROM runs c JOIN runs n ON n.tile_id = c.tile_id AND n.label <> c.label AND pow(n.y - c.y, 2) + pow(n.x - c.x, 2) <= 4")
def _(s):
    return masks.touching(s.runs, 2)


@query("fl13_good_tiles", "tile_id:l n_pairs:l score:d", "SELECT * FROM results WHERE n_pairs >= 2 AND score > 0.3")
def _(s):
    return manual.good_tiles(s.results, 2, 0.3)


@query("fl14_select_final", "tile_id:l mode:s", """
SELECT tile_id, m AS mode FROM (SELECT *, CASE WHEN count(*) FILTER (WHERE n_pairs >= 2 AND score > 0.3) OVER () >= 20 THEN 'nuclei_pair' WHEN count(*) FILTER (WHERE score > 0.3) OVER () >= 20 THEN 'tile_center' END AS m FROM results)
WHERE CASE WHEN m = 'nuclei_pair' THEN n_pairs >= 2 AND score > 0.3 ELSE m = 'tile_center' AND score > 0.3 END""")
def _(s):
    return manual.select_final(s.results, 20, 2, 0.3, need="empty")


@query("fl14_fallback", "tile_id:l mode:s", """
SELECT tile_id, 'tile_center' AS mode FROM results WHERE score > 0.3 AND (SELECT count(*) FILTER (WHERE n_pairs >= 9) < 1 AND count(*) FILTER (WHERE score > 0.3) >= 1 FROM results)""")
def _(s):
    return manual.select_final(s.results, 1, 9, 0.3, need="empty")


@query("fl15_points_in_view", "pid:l x:d y:d", """
SELECT pid, x, y FROM (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS r, count(*) OVER () AS n FROM pts WHERE x BETWEEN 0 AND 4999 AND y BETWEEN 0 AND 699) WHERE r % greatest(1, CAST(ceil(n / 100) AS BIGINT)) = 0""")
def _(s):
    return sampling.in_view(s.pts, 5000, 700, 100)


@query("fl16_existing_files", "vec_id:l path:s", "SELECT vec_id, path FROM names WHERE path LIKE '%he.png'")
def _(s):
    from ..sources.artefacts import existing

    return existing(s.names.where(F.col("path").endswith("he.png")).select("path"), s.names)


@query("fl17_valid_index", "pid:l used:b", "SELECT pid, pid % 3 = 0 AS used FROM anchors")
def _(s):
    chosen = s.anchors.where("pid % 3 = 0").select("pid")
    kept, gone = manual.split_by_key(s.anchors.select("pid"), chosen, ("pid",))
    return gone.withColumn("used", F.lit(True)).unionByName(kept.withColumn("used", F.lit(False)))


@query("fl18_absorbing_pixels", "tile_id:l y:l x:l", "SELECT tile_id, y, x FROM rgb WHERE least(-ln((r + 1.0::DOUBLE) / 240), -ln((g + 1.0::DOUBLE) / 240), -ln((b + 1.0::DOUBLE) / 240)) >= 0.15")
def _(s):
    od = [-F.log((F.col(c) + lit(1)) / lit(240)) for c in "rgb"]
    return s.rgb.where(F.least(*od) >= 0.15)


@query("fl19_nonempty_tiles", "tile_id:l", "SELECT tile_id FROM tiles WHERE least(200, round_even(x0 + w, 0)) > greatest(0, round_even(x0, 0)) AND least(150, round_even(y0 + h, 0)) > greatest(0, round_even(y0, 0))")
def _(s):
    return geometry.clamped(s.tiles, 200, 150)


_PLACE = "SELECT pid, CAST(round_even((x0 + {x}) * 1.5, 0) AS BIGINT) AS gx, CAST(round_even((y0 + {y}) * 1.5, 0) AS BIGINT) AS gy FROM (SELECT pid, tile_id, CASE WHEN pid % 4 > 0 THEN sx END AS x, CASE WHEN pid % 4 > 0 THEN sy END AS y FROM anchors) a JOIN tiles USING (tile_id)"


def _local(s):
    some = F.col("pid") % 4 > 0
    return s.anchors.select("pid", "tile_id", F.when(some, F.col("sx")).alias("x"), F.when(some, F.col("sy")).alias("y"))


@query("jn01_place_anchors", "pid:l gx:l gy:l", _PLACE.format(x="x", y="y") + " WHERE x IS NOT NULL")
def _(s):
    return manual.place_anchors(_local(s).where("x is not null"), s.tiles, 1.5)


@query("jn02_place_or_centre", "pid:l gx:l gy:l", _PLACE.format(x="coalesce(x, w / 2)", y="coalesce(y, h / 2)"))
def _(s):
    return manual.place_anchors(_local(s), s.tiles, 1.5, default_to_centre=True)


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, nucleus_id, kind ORDER BY seq DESC) AS rn FROM overrides) WHERE rn = 1"


@query("jn03_with_overrides", "tile_id:l nucleus_id:l dapi_x:d dapi_y:d he_x:d he_y:d overridden:b", f"""
WITH last AS ({_LAST}) SELECT c.tile_id, c.nucleus_id, coalesce(d.x, dapi_x) AS dapi_x, coalesce(d.y, dapi_y) AS dapi_y, coalesce(h.x, he_x) AS he_x, coalesce(h.y, he_y) AS he_y,
 d.x IS NOT NULL OR h.x IS NOT NULL AS overridden FROM centroids c LEFT JOIN last d ON d.tile_id = c.tile_id AND d.nucleus_id = c.nucleus_id AND d.kind = 'dapi'
LEFT JOIN last h ON h.tile_id = c.tile_id AND h.nucleus_id = c.nucleus_id AND h.kind = 'he'""")
def _(s):
    return manual.with_overrides(s.centroids, s.overrides)


@query("jn04_masks_with_partner", "vec_id:l path:s", """
SELECT vec_id, path FROM names WHERE path LIKE '%mask.png' AND vec_id // 3 IN (SELECT vec_id // 3 FROM names WHERE path LIKE '%he.png' AND vec_id % 2 = 0)""")
def _(s):
    g = s.names.withColumn("k", F.floor(F.col("vec_id") / 3))
    he = g.where(F.col("path").endswith("he.png") & (F.col("vec_id") % 2 == 0))
    return g.where(F.col("path").endswith("mask.png")).join(he.select("k").distinct(), "k", "left_semi")


@query("jn05_matched_tiles", "tile_id:l matched:b", """
SELECT DISTINCT tile_id, TRUE AS matched FROM anchors WHERE tile_id IN (SELECT tile_id FROM tiles) UNION ALL
SELECT tile_id, FALSE FROM (SELECT DISTINCT tile_id FROM anchors WHERE tile_id NOT IN (SELECT tile_id FROM tiles) UNION ALL SELECT tile_id FROM tiles WHERE tile_id NOT IN (SELECT tile_id FROM anchors))""")
def _(s):
    kept, rest = manual.matched_keys(s.anchors.select("tile_id").distinct(), s.tiles, "tile_id")
    return kept.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False)))


@query("jn06_zip_tiles", "tile_id:l x0:d score:d", "SELECT tile_id, x0, score FROM tiles JOIN results USING (tile_id)")
def _(s):
    return s.tiles.join(s.results, "tile_id")


@query("jn07_pair_cells", "pair_id:l a:l b:l inter:l f1:d", "SELECT pair_id, a, b, inter, f1 FROM pairs WHERE least(cov_a, cov_b) >= 0.4")
def _(s):
    return masks.overlap_pairs(s.ra, s.rb, 0.4, PAIR)


_NEAREST = "SELECT * FROM (SELECT pid, x, y, cid, pow(x - cx, 2) + pow(y - cy, 2) AS d2, row_number() OVER (PARTITION BY pid ORDER BY pow(x - cx, 2) + pow(y - cy, 2), cid) AS rn FROM pts, centres) WHERE rn = 1"


@query("jn08_nearest_centre", "pid:l cid:l d2:d", _NEAREST)
def _(s):
    return sampling.nearest_centre(s.pts, s.centres)


_CLOSE = "SELECT a.pid AS i, b.pid AS j, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM {t} a JOIN {t} b ON a.pid < b.pid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {r} * {r}"


@query("jn09_close_pairs", "i:l j:l d2:f", _CLOSE.format(t="pts", r=40))
def _(s):
    return masks.close_pairs(s.pts, 40)


@query("jn10_search_grid", "scale:d tx:l ty:l", "SELECT scale, tx, ty FROM (SELECT unnest([0.9, 1.0, 1.1]) AS scale), (SELECT unnest(range(-2, 3)) AS tx), (SELECT unnest(range(-2, 3)) AS ty)")
def _(s):
    from ..operators.search import search_grid

    return search_grid(s.spark, [0.9, 1.0, 1.1], range(-2, 3), range(-2, 3))


_SCORES = "SELECT ma.pair_id, sum(ma.fg * mb.fg) AS ab, sum(ma.fg) AS a, sum(mb.fg) AS b FROM ma JOIN mb ON ma.pair_id = mb.pair_id AND ma.y = mb.y AND ma.x = mb.x GROUP BY ma.pair_id"


@query("jn11_mask_overlap", "pair_id:l n_and:l n_or:l", f"SELECT pair_id, ab AS n_and, a + b - ab AS n_or FROM ({_SCORES})")
def _(s):
    j = s.ma.select("pair_id", "y", "x", F.col("fg").alias("a")).join(s.mb.select("pair_id", "y", "x", F.col("fg").alias("b")), ["pair_id", "y", "x"])
    return j.groupBy("pair_id").agg(F.sum(F.col("a") * F.col("b")).alias("n_and"), F.sum(F.greatest("a", "b")).alias("n_or"))


@query("jn12_label_probe", "tile_id:l label:l", "SELECT t.tile_id, coalesce(label, 0) AS label FROM (SELECT DISTINCT tile_id FROM px) t LEFT JOIN runs r ON r.tile_id = t.tile_id AND r.y = 4 AND r.x = t.tile_id % 8")
def _(s):
    clicks = s.px.select("tile_id").distinct().withColumns({"y": F.lit(4), "x": (F.col("tile_id") % 8).cast("int")})
    return clicks.join(s.runs.select("tile_id", "y", "x", "label"), ["tile_id", "y", "x"], "left").select("tile_id", F.coalesce("label", F.lit(0)).alias("label"))


_DIST = "SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM spots a JOIN spots b ON a.pid < b.pid"


@query("jn13_pair_distances", "n:l mean:d far:d", f"SELECT count(*) AS n, avg(d) AS mean, max(d) AS far FROM ({_DIST})")
def _(s):
    return sampling.dispersion(s.spots)


@query("jn14_lut_lookup", "tile_id:l y:l x:l r:l", "SELECT tile_id, y, x, 255 - v AS r FROM px")
def _(s):
    return raster.apply_lut(s.px, raster.inverted_lut(s.spark))


@query("jn15_click_order", "k:l rank:l ax:d bx:d", """
SELECT a.k, a.rank, a.x AS ax, b.x AS bx FROM (SELECT nucleus_id AS k, x, row_number() OVER (PARTITION BY nucleus_id ORDER BY seq) AS rank FROM overrides WHERE kind = 'dapi') a
JOIN (SELECT nucleus_id AS k, x, row_number() OVER (PARTITION BY nucleus_id ORDER BY seq) AS rank FROM overrides WHERE kind = 'he') b USING (k, rank)""")
def _(s):
    o = s.overrides.withColumn("k", F.col("nucleus_id"))
    p = manual.paired_by_rank(o.where("kind = 'dapi'"), o.where("kind = 'he'"), "k", "seq")
    return p.select("k", "rank", F.col("a_x").alias("ax"), F.col("b_x").alias("bx"))


@query("jn16_source_windows", "a:l b:l", "SELECT a.tile_id AS a, b.tile_id AS b FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h")
def _(s):
    # boxes meet in grid cells of 64 pixels; a pair counts in the first cell that they share
    g = s.tiles.withColumns({"gx": F.explode(F.sequence(F.floor(F.col("x0") / 64), F.floor((F.col("x0") + F.col("w")) / 64)))})
    g = g.withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / 64), F.floor((F.col("y0") + F.col("h")) / 64))))
    a, b = (g.select("gx", "gy", *[F.col(c).alias(f"{n}_{c}") for c in ("tile_id", "x0", "y0", "w", "h")]) for n in "ab")
    hit = a.join(b, ["gx", "gy"]).where("a_tile_id < b_tile_id and a_x0 < b_x0 + b_w and b_x0 < a_x0 + a_w and a_y0 < b_y0 + b_h and b_y0 < a_y0 + a_h")
    return hit.select(F.col("a_tile_id").alias("a"), F.col("b_tile_id").alias("b")).distinct()


@query("ag01_min_max", "tile_id:l lo:l hi:l", "SELECT tile_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY tile_id")
def _(s):
    return s.px.groupBy("tile_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("ag02_percentiles", "tile_id:l p2:d p25:d p45:d p75:d p98:d p997:d", """
SELECT tile_id, quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.45) AS p45, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.98) AS p98, quantile_cont(v, 0.997) AS p997 FROM px GROUP BY tile_id""")
def _(s):
    p = F.percentile("v", F.array(*map(lit, (0.02, 0.25, 0.45, 0.75, 0.98, 0.997))))
    return s.px.groupBy("tile_id").agg(p.alias("p")).select("tile_id", *[F.col("p")[i].alias(n) for i, n in enumerate(("p2", "p25", "p45", "p75", "p98", "p997"))])


@query("ag03_median", "tile_id:l m:d", "SELECT tile_id, median(v) AS m FROM px GROUP BY tile_id")
def _(s):
    return s.px.groupBy("tile_id").agg(F.median("v").alias("m"))


_OTSU = """SELECT tile_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, v) AS rn FROM (SELECT tile_id, v,
 round_even(coalesce(n0 * n1 * pow(s0 / n0 - s1 / nullif(n1, 0), 2), 0), 6) AS score FROM (SELECT tile_id, v, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n * v) OVER w AS DOUBLE) AS s0,
 CAST(sum(n) OVER (PARTITION BY tile_id) - sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * v) OVER (PARTITION BY tile_id) - sum(n * v) OVER w AS DOUBLE) AS s1
 FROM (SELECT tile_id, v, count(*) AS n FROM px GROUP BY ALL) WINDOW w AS (PARTITION BY tile_id ORDER BY v)))) WHERE rn = 1"""


@query("ag04_otsu", "tile_id:l threshold:l", _OTSU)
def _(s):
    return raster.otsu(s.px)


_CC = """WITH RECURSIVE small AS (SELECT tile_id, y, x, y * 8 + x AS id FROM pm WHERE fg = 1),
reach AS (SELECT tile_id, id, id AS r FROM small UNION SELECT n.tile_id, n.id, reach.r FROM reach JOIN small c ON c.tile_id = reach.tile_id AND c.id = reach.id
 JOIN small n ON n.tile_id = c.tile_id AND {near}), lab AS (SELECT tile_id, id, min(r) AS root FROM reach GROUP BY tile_id, id)
SELECT tile_id, root, count(*) AS area, avg(id % 8) AS cx, avg(id // 8) AS cy FROM lab GROUP BY tile_id, root"""


def _labelled(s, connectivity):
    lab = masks.components(s.pm, connectivity)
    root = lab.where("label > 0").groupBy("tile_id", "label").agg(F.min(F.col("y") * 8 + F.col("x")).alias("root"))
    return masks.component_stats(lab).join(root, ["tile_id", "label"])


@query("ag05_components8", "tile_id:l root:l area:l cx:d cy:d", _CC.format(near="greatest(abs(n.y - c.y), abs(n.x - c.x)) = 1"))
def _(s):
    return _labelled(s, 8)


@query("ag06_components4", "tile_id:l root:l area:l cx:d cy:d", _CC.format(near="abs(n.y - c.y) + abs(n.x - c.x) = 1"))
def _(s):
    return _labelled(s, 4)


@query("ag07_component_count", "tile_id:l n:l", "SELECT tile_id, count(*) FILTER (WHERE area >= 2) AS n FROM comps GROUP BY tile_id")
def _(s):
    return s.comps.groupBy("tile_id").agg(F.count_if(F.col("area") >= 2).alias("n"))


@query("ag08_dice", "pair_id:l dice:d", f"SELECT pair_id, 2 * ab / (a + b + 1e-6::DOUBLE) AS dice FROM ({_SCORES})")
def _(s):
    return masks.mask_scores(s.ma, s.mb, PAIR)


@query("ag09_iou", "pair_id:l iou:d", f"SELECT pair_id, ab / (a + b - ab + 1e-6::DOUBLE) AS iou FROM ({_SCORES})")
def _(s):
    return masks.mask_scores(s.ma, s.mb, PAIR)


@query("ag10_coverage", "pair_id:l a:l b:l cov_a:d cov_b:d sym:d f1:d", "SELECT *, least(cov_a, cov_b) AS sym FROM pairs")
def _(s):
    return masks.overlap_pairs(s.ra, s.rb, 0.0, PAIR).withColumn("sym", F.least("cov_a", "cov_b"))


@query("ag11_foreground_ratio", "tile_id:l ratio:d", "SELECT tile_id, avg(fg) AS ratio FROM pm GROUP BY tile_id")
def _(s):
    return s.pm.groupBy("tile_id").agg(F.avg("fg").alias("ratio"))


@query("ag12_grid_argmax", "g:l scale:d tx:l ty:l score:d", """
SELECT g, scale, tx, ty, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, scale, tx, ty) AS rn FROM
 (SELECT p_size % 7 AS g, 1 + p_partkey % 3 AS scale, p_partkey % 5 AS tx, p_partkey % 11 AS ty, p_size % 10 / 10 AS score FROM part)) WHERE rn = 1""")
def _(s):
    from ..operators.search import best_alignment

    k = F.col("p_partkey")
    rows = s.table("part").select((F.col("p_size") % 7).alias("g"), (1 + k % 3).cast("double").alias("scale"), (k % 5).alias("tx"), (k % 11).alias("ty"), (F.col("p_size") % 10 / 10).alias("score"))
    return best_alignment(rows, ("g",))


_LLOYD = f"""WITH owned AS ({_NEAREST}), mean AS (SELECT cid, avg(x) AS mx, avg(y) AS my FROM owned GROUP BY cid)
SELECT c.cid, coalesce(k.x, c.cx) AS cx, coalesce(k.y, c.cy) AS cy FROM centres c LEFT JOIN (SELECT * FROM (SELECT owned.cid, x, y, row_number() OVER (PARTITION BY owned.cid ORDER BY round(pow(x - mx, 2) + pow(y - my, 2), 6), pid) AS rn FROM owned JOIN mean USING (cid)) WHERE rn = 1) k USING (cid)"""


@query("ag13_cell_medoid", "cid:l cx:d cy:d", _LLOYD)
def _(s):
    return sampling.lloyd_step(s.pts, s.centres)


@query("ag14_dispersion", "mean:d sd:d", f"SELECT avg(d) AS mean, stddev_pop(d) AS sd FROM ({_DIST})")
def _(s):
    return sampling.dispersion(s.spots)


_ERR = "SELECT *, sqrt(pow(1.02::DOUBLE * sx - 0.03::DOUBLE * sy + 40 - dx, 2) + pow(0.02::DOUBLE * sx + 0.98::DOUBLE * sy - 25 - dy, 2)) AS error FROM anchors"


@query("ag15_inlier_summary", "num_points:l num_inliers:l mean_error:d median_error:d", f"""
SELECT count(*) AS num_points, count(*) FILTER (WHERE error <= 8) AS num_inliers, avg(error) FILTER (WHERE error <= 8) AS mean_error, median(error) FILTER (WHERE error <= 8) AS median_error FROM ({_ERR})""")
def _(s):
    return fitting.inlier_summary(s.anchors, ANCHOR_MAP)


@query("ag16_covariance", "rr:d rg:d rb:d gb:d", "SELECT covar_samp(r, r) AS rr, covar_samp(r, g) AS rg, covar_samp(r, b) AS rb, covar_samp(g, b) AS gb FROM rgb")
def _(s):
    return s.rgb.agg(*[F.covar_samp(a, b).alias(a + b) for a, b in ("rr", "rg", "rb", "gb")])


@query("ag17_pair_funnel", "pair_id:l n_total:l n_inter:l n_sym:l", """
SELECT t.pair_id, na * nb AS n_total, coalesce(n_inter, 0) AS n_inter, coalesce(n_sym, 0) AS n_sym FROM (SELECT pair_id, count(DISTINCT label) AS na FROM ra GROUP BY pair_id) t
JOIN (SELECT pair_id, count(DISTINCT label) AS nb FROM rb GROUP BY pair_id) u USING (pair_id)
LEFT JOIN (SELECT pair_id, count(*) AS n_inter, count(*) FILTER (WHERE least(cov_a, cov_b) >= 0.4) AS n_sym FROM pairs GROUP BY pair_id) v USING (pair_id)""")
def _(s):
    return masks.pair_funnel(s.ra, s.rb, 0.4, PAIR)


@query("ag18_failures", "event_type:s n:l", "SELECT event_type, count(*) FILTER (WHERE event_id % 6 = 0) AS n FROM events GROUP BY event_type")
def _(s):
    e = s.table("events").withColumn("msg", F.when(F.col("event_id") % 6 == 0, "Failed: no mask").otherwise("done"))
    return e.groupBy("event_type").agg(F.count_if(F.startswith("msg", F.lit("Failed:"))).alias("n"))


@query("ag19_close_degree", "pid:l bad:l", f"SELECT pid, count(*) AS bad FROM (SELECT i AS pid FROM ({_CLOSE.format(t='pts', r=40)}) UNION ALL SELECT j FROM ({_CLOSE.format(t='pts', r=40)})) GROUP BY pid")
def _(s):
    return sampling.crowding(s.pts, 40)


_CLUSTER = f"""WITH RECURSIVE link AS ({_CLOSE.format(t="spots", r=25)}), sym AS (SELECT i, j FROM link UNION ALL SELECT j, i FROM link),
reach AS (SELECT pid, pid AS r FROM spots UNION SELECT sym.j, reach.r FROM reach JOIN sym ON sym.i = reach.pid), lab AS (SELECT pid, min(r) AS cluster FROM reach GROUP BY pid)
SELECT cluster, count(*) AS n, sum(pid % 10 + 1) AS area FROM lab GROUP BY cluster"""


def _clusters(s):
    stats = s.spots.select(F.lit(0).alias("tile_id"), F.col("pid").alias("label"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("pid") % 10 + 1).alias("area"))
    return masks.clusters(stats, 25)


@query("ag20_clusters", "cluster:l n:l area:l", _CLUSTER)
def _(s):
    return _clusters(s).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("ag21_extent", "x0:d x1:d y0:d y1:d", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts")
def _(s):
    return s.pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


_TOP = "SELECT pair_id, a, b, rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(f1, 9) DESC, a, b) AS rank FROM pairs) WHERE rank <= {k}"


@query("wn01_top_pairs", "pair_id:l a:l b:l rank:l", _TOP.format(k=3))
def _(s):
    return masks.top_pairs(masks.overlap_pairs(s.ra, s.rb, 0.0, PAIR), 3, PAIR)


@query("wn02_first_pairs", "pair_id:l a:l b:l rank:l", "SELECT * FROM (" + _TOP.format(k=2) + ") WHERE pair_id % 2 = 0")
def _(s):
    top = masks.top_pairs(masks.overlap_pairs(s.ra, s.rb, 0.0, PAIR), 3, PAIR)
    return top.where("pair_id % 2 = 0 and rank <= 2")


_CELLS = "SELECT pid, x, y, pid % 17 AS score, least(5, CAST(floor((x - x0) / (x1 - x0) * 6) AS BIGINT)) AS gx, least(5, CAST(floor((y - y0) / (y1 - y0) * 6) AS BIGINT)) AS gy FROM pts, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)"


@query("wn03_grid_balanced", "pid:l gx:l gy:l", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY score DESC, pid) AS rn FROM ({_CELLS})) WHERE rn <= 4")
def _(s):
    return sampling.grid_balanced(s.pts.withColumn("score", F.col("pid") % 17))


@query("wn03_grid_spread", "pid:l gx:l gy:l")
def _(s):
    return sampling.grid_balanced(s.pts.withColumn("score", F.col("pid") % 17), prefer="spread")


@query("wn04_farthest_points", "step:l pid:l", """
WITH m AS (SELECT avg(x) AS mx, avg(y) AS my FROM pts), a AS (SELECT pid, x, y FROM pts, m ORDER BY round(pow(x - mx, 2) + pow(y - my, 2), 6), pid LIMIT 1),
b AS (SELECT p.pid, p.x, p.y FROM pts p, a ORDER BY round(pow(p.x - a.x, 2) + pow(p.y - a.y, 2), 6) DESC, p.pid LIMIT 1),
c AS (SELECT p.pid FROM pts p, a, b ORDER BY round(least(pow(p.x - a.x, 2) + pow(p.y - a.y, 2), pow(p.x - b.x, 2) + pow(p.y - b.y, 2)), 6) DESC, p.pid LIMIT 1)
SELECT 0 AS step, pid FROM a UNION ALL SELECT 1, pid FROM b UNION ALL SELECT 2, pid FROM c""")
def _(s):
    return sampling.farthest_points(s.pts, 3)


@query("wn05_last_write", "tile_id:l nucleus_id:l kind:s x:d y:d", _LAST)
def _(s):
    return manual.last_of_key(s.overrides)


@query("wn06_first_tiles", "path:s", "SELECT path FROM names ORDER BY path LIMIT 12")
def _(s):
    return s.names.select("path").orderBy("path").limit(12)


@query("wn07_ids_in_tile", "tile_id:l pid:l idx:l", "SELECT tile_id, pid, row_number() OVER (PARTITION BY tile_id ORDER BY pid) - 1 AS idx FROM anchors")
def _(s):
    return manual.numbered(s.anchors, ["pid"])


_MORPH = "SELECT c.tile_id, c.y, c.x, {f}(n.v) AS v FROM {t} c JOIN {t} n ON n.tile_id = c.tile_id AND " + _DISK1 + " GROUP BY ALL"


@query("wn08_erode", "tile_id:l y:l x:l v:l", _MORPH.format(f="min", t="px"))
def _(s):
    return raster.erode(s.px, raster.disk(1))


@query("wn08_dilate", "tile_id:l y:l x:l v:l", _MORPH.format(f="max", t="px"))
def _(s):
    return raster.dilate(s.px, raster.disk(1))


@query("wn08_open", "tile_id:l y:l x:l v:l", f"WITH e AS ({_MORPH.format(f='min', t='px')}) {_MORPH.format(f='max', t='e')}")
def _(s):
    return raster.opening(s.px, raster.disk(1))


@query("wn08_box_sum", "tile_id:l y:l x:l v:d", "SELECT c.tile_id, c.y, c.x, sum(n.v) AS v FROM px c JOIN px n ON n.tile_id = c.tile_id AND greatest(abs(n.y - c.y), abs(n.x - c.x)) <= 2 GROUP BY ALL")
def _(s):
    return raster.neighbourhood(s.px, raster.square(2), "sum")


@query("wn08_distance", "tile_id:l y:l x:l d2:l", """
SELECT c.tile_id, c.y, c.x, coalesce(min(pow(n.y - c.y, 2) + pow(n.x - c.x, 2)), 256) AS d2 FROM pm c LEFT JOIN pm n ON n.tile_id = c.tile_id AND n.fg = 0 GROUP BY ALL""")
def _(s):
    return masks.per_image(s.pm, lambda a: (masks.chamfer(a > 0) ** 2).round(), "d2").withColumn("d2", F.least("d2", F.lit(256)))


@query("wn09_stride", "pid:l", "SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS r FROM pts) WHERE r % 7 = 0")
def _(s):
    return sampling.numbered(s.pts, [F.col("pid")], "r").where("r % 7 = 0")


@query("so01_best_pairs", "pair_id:l a:l b:l", "SELECT pair_id, a, b FROM pairs ORDER BY round(f1, 9) DESC, pair_id, a, b LIMIT 20")
def _(s):
    return masks.overlap_pairs(s.ra, s.rb, 0.0, PAIR).orderBy(F.desc(F.round("f1", 9)), "pair_id", "a", "b").limit(20)


@query("so02_largest_clusters", "cluster:l area:l rank:l", f"SELECT cluster, area, row_number() OVER (ORDER BY area DESC, cluster) AS rank FROM ({_CLUSTER}) QUALIFY rank <= 15")
def _(s):
    return masks.top_clusters(_clusters(s), 15)


@query("so03_worst_first", "pid:l rank:l", f"SELECT pid, row_number() OVER (ORDER BY bad DESC, pid) AS rank FROM (SELECT pid, count(*) AS bad FROM (SELECT i AS pid FROM ({_CLOSE.format(t='pts', r=40)}) UNION ALL SELECT j FROM ({_CLOSE.format(t='pts', r=40)})) GROUP BY pid) QUALIFY rank <= 25")
def _(s):
    top = sampling.crowding(s.pts, 40).limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bad"), "pid")))


@query("so04_sorted_files", "path:s", "SELECT path FROM names ORDER BY path")
def _(s):
    return s.names.select("path").orderBy("path")


@query("so05_quad_extremes", "tile_id:l s_min:d s_max:d d_min:d d_max:d", "SELECT tile_id, x0 + y0 AS s_min, x0 + w + y0 + h AS s_max, x0 - y0 - h AS d_min, x0 + w - y0 AS d_max FROM tiles")
def _(s):
    t = s.tiles
    corner = F.explode(F.array(*[F.struct((F.col("x0") + F.col("w") * u).alias("x"), (F.col("y0") + F.col("h") * v).alias("y")) for u, v in geometry.CORNERS]))
    c = t.select("tile_id", corner.alias("c")).select("tile_id", (F.col("c.x") + F.col("c.y")).alias("s"), (F.col("c.x") - F.col("c.y")).alias("d"))
    return c.groupBy("tile_id").agg(F.min("s").alias("s_min"), F.max("s").alias("s_max"), F.min("d").alias("d_min"), F.max("d").alias("d_max"))


@query("so06_capped_sample", "y:l x:l")
def _(s):
    mask = s.big.withColumn("fg", (F.col("v") > 100).cast("int"))
    return sampling.valid_coords(mask, cap=500, seed=3)


@query("so07_distinct_sorted", "tile_id:l", "SELECT DISTINCT tile_id FROM anchors ORDER BY tile_id")
def _(s):
    return s.anchors.select("tile_id").distinct().orderBy("tile_id")


_FA, _FB = ("SELECT pair_id, y, x FROM {} WHERE fg = 1".format(t) for t in ("ma", "mb"))


def _on(df):
    return df.where("fg = 1").select("pair_id", "y", "x")


@query("st01_intersection", "pair_id:l y:l x:l", f"{_FA} INTERSECT {_FB}")
def _(s):
    return _on(s.ma).intersect(_on(s.mb))


@query("st02_union", "pair_id:l y:l x:l", f"{_FA} UNION {_FB}")
def _(s):
    return _on(s.ma).union(_on(s.mb)).distinct()


@query("st03_difference", "pair_id:l y:l x:l", f"{_FA} EXCEPT {_FB}")
def _(s):
    return _on(s.ma).join(_on(s.mb), ["pair_id", "y", "x"], "left_anti")


@query("st04_key_sets", "tile_id:l side:s", """
(SELECT tile_id, 'both' AS side FROM (SELECT tile_id FROM anchors INTERSECT SELECT tile_id FROM tiles)) UNION ALL (SELECT tile_id, 'left' FROM (SELECT tile_id FROM anchors EXCEPT SELECT tile_id FROM tiles))""")
def _(s):
    a, b = s.anchors.select("tile_id"), s.tiles.select("tile_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("st05_complement", "tile_id:l y:l x:l v:l", "SELECT tile_id, y, x, 255 - 255 * fg AS v FROM pm")
def _(s):
    return s.pm.withColumn("v", 255 - 255 * F.col("fg"))


@query("st06_label_membership", "tile_id:l y:l x:l label:l", "SELECT tile_id, runs.y, runs.x, label FROM runs JOIN comps USING (tile_id, label) WHERE area = 3")
def _(s):
    return s.runs.join(s.comps.where("area = 3").select("tile_id", "label"), ["tile_id", "label"], "left_semi")


@query("st07_complement_index", "pid:l", "SELECT pid FROM anchors WHERE pid % 3 <> 0")
def _(s):
    return s.anchors.select("pid").join(s.anchors.where("pid % 3 = 0").select("pid"), "pid", "left_anti")


@query("st08_candidate_union", "tile_id:l mode:s n_pairs:l", "SELECT tile_id, 'nuclei_pair' AS mode, n_pairs FROM results WHERE n_pairs > 2 UNION ALL SELECT tile_id, 'tile_center', NULL FROM results WHERE n_pairs <= 2")
def _(s):
    a = s.results.where("n_pairs > 2").select("tile_id", F.lit("nuclei_pair").alias("mode"), "n_pairs")
    return a.unionByName(s.results.where("n_pairs <= 2").select("tile_id", F.lit("tile_center").alias("mode")), allowMissingColumns=True)


_OLD = "SELECT * FROM overrides WHERE seq % 2 = 0"
_NEW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, nucleus_id, kind ORDER BY seq DESC) AS rn FROM overrides WHERE seq % 10 = 1) WHERE rn = 1"
_SAME = "o.tile_id = n.tile_id AND o.nucleus_id = n.nucleus_id AND o.kind = n.kind"


@query("dm01_upsert", "seq:l tile_id:l nucleus_id:l kind:s x:d", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT seq, tile_id, nucleus_id, kind, x FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_SAME}) UNION ALL SELECT seq, tile_id, nucleus_id, kind, x FROM n")
def _(s):
    o = s.overrides
    return manual.upsert(o.where("seq % 2 = 0"), manual.last_of_key(o.where("seq % 10 = 1")))


@query("dm02_delete", "seq:l tile_id:l", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT seq, tile_id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_SAME})")
def _(s):
    o = s.overrides
    return manual.delete(o.where("seq % 2 = 0"), o.where("seq % 10 = 1"))


@query("dm03_delete_returning", "seq:l removed:b", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT seq, EXISTS (SELECT 1 FROM n WHERE {_SAME}) AS removed FROM o")
def _(s):
    o = s.overrides
    kept, gone = manual.split_by_key(o.where("seq % 2 = 0"), o.where("seq % 10 = 1"), manual.OVERRIDE_KEY)
    return kept.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)))


@query("dm04_drop_with_tombstone", "seq:l what:s", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM n WHERE {_SAME}) THEN 'tombstone' ELSE 'kept' END AS what FROM o")
def _(s):
    o = s.overrides
    kept, gone = manual.split_by_key(o.where("seq % 2 = 0"), o.where("seq % 10 = 1"), manual.OVERRIDE_KEY)
    return kept.withColumn("what", F.lit("kept")).unionByName(gone.withColumn("what", F.lit("tombstone")))


@query("dm05_merge_objects", "tile_id:l x0:d score:d", "SELECT tile_id, coalesce(b.x0, a.x0) AS x0, coalesce(b.s, a.s) AS score FROM (SELECT tile_id, x0, 1 AS s FROM tiles WHERE tile_id % 3 > 0) a FULL JOIN (SELECT tile_id, CASE WHEN tile_id % 5 > 0 THEN x0 + 1 END AS x0, 2 AS s FROM tiles WHERE tile_id % 2 = 0) b USING (tile_id)")
def _(s):
    a = s.tiles.where("tile_id % 3 > 0").select("tile_id", "x0", lit(1).alias("score"))
    b = s.tiles.where("tile_id % 2 = 0").select("tile_id", F.when(F.col("tile_id") % 5 > 0, F.col("x0") + 1).alias("x0"), lit(2).alias("score"))
    return manual.merge_objects(a, b, "tile_id", ("x0", "score"))


@query("dm06_append_only", "seq:l tile_id:l", f"{_OLD.replace('*', 'seq, tile_id')} UNION ALL SELECT seq, tile_id FROM overrides WHERE seq % 10 = 1")
def _(s):
    o = s.overrides
    return o.where("seq % 2 = 0").unionByName(o.where("seq % 10 = 1"))
