"""Scan and sink queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import level0, lit
from ..lineage import scratch
from ..operators import geometry, raster
from ..sources import artefacts, export, images
from .adapters import ANCHOR_MAP, HOMOGRAPHY, SIDE, SLIDE_WIDTH
from .registry import query


@query("sc01_read_image", "tile_id:l y:l x:l v:l", "SELECT * FROM px")
def _(s):
    got = images.decode_files(images.encode_png(s.px))
    return got.withColumn("tile_id", F.col("image_id"))


@query("sc02_pick_level", "image:l level:l", """
SELECT image, coalesce(min(level) FILTER (WHERE least(h, w) BETWEEN 1000 AND 2000), 0) AS level FROM levels GROUP BY image""")
def _(s):
    return raster.pick_level(s.levels)


@query("sc03_overview", "tile_id:l y:l x:l v:d", "SELECT tile_id, y // 4 AS y, x // 4 AS x, avg(v) AS v FROM px GROUP BY ALL")
def _(s):
    return raster.overview(s.px, 2)


@query("sc03_halvings", "image:l level:l k:l", """
SELECT image, level, CASE WHEN least(h, w) <= 2000 THEN 0 ELSE floor(log2(least(h, w) / 2001)) + 1 END AS k FROM levels""")
def _(s):
    return s.levels.withColumn("k", raster.halvings(F.col("h"), F.col("w"), 2000))


@query("sc04_channel_policy", "n_nationkey:l auto:s he:s dapi:s third:s", """
SELECT n_nationkey, CASE WHEN a = 'CYX' THEN CASE WHEN c >= 4 THEN '0' ELSE 'all' END ELSE CASE WHEN c IN (3, 4) THEN 'all' ELSE '0' END END AS auto,
  CASE WHEN a = 'CYX' AND c = 3 OR a = 'YXC' AND c IN (3, 4) THEN 'all' END AS he, '0' AS dapi, CASE WHEN c > 2 THEN '2' END AS third
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'CYX' ELSE 'YXC' END AS a, 1 + n_nationkey % 5 AS c FROM nation)""")
def _(s):
    n = F.col("n_nationkey")
    a, c = F.when(n % 2 == 0, "CYX").otherwise("YXC"), 1 + n % 5
    return s.table("nation").select(n, raster.channel_plan(a, c).alias("auto"), raster.channel_plan(a, c, "he").alias("he"),
                                    raster.channel_plan(a, c, "dapi").alias("dapi"), raster.channel_plan(a, c, 2).alias("third"))


@query("sc05_infer_axes", "n_nationkey:l axes:s", """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'YX' WHEN 1 THEN 'YXC' WHEN 2 THEN 'CYX' ELSE 'YXC' END AS axes FROM nation""")
def _(s):
    n = F.col("n_nationkey") % 4
    shape = F.when(n == 0, F.array(F.lit(9), F.lit(9))).when(n == 1, F.array(F.lit(9), F.lit(9), F.lit(3))).when(n == 2, F.array(F.lit(3), F.lit(9), F.lit(9))).otherwise(F.array(F.lit(9), F.lit(9), F.lit(4)))
    return s.table("nation").select("n_nationkey", raster.infer_axes(shape).alias("axes"))


@query("sc06_replicated_grey", "tile_id:l grey:b", """
SELECT tile_id, bool_and(v = g) AS grey FROM (SELECT tile_id, v, CASE WHEN tile_id % 2 = 0 THEN v ELSE 255 - v END AS g FROM px) GROUP BY tile_id""")
def _(s):
    v = F.col("v")
    return raster.replicated_grey(s.px.withColumns({"r": v, "g": F.when(F.col("tile_id") % 2 == 0, v).otherwise(255 - v), "b": F.when(F.col("tile_id") % 2 == 0, v).otherwise(255 - v)}))


@query("sc07_minmax_u8", "tile_id:l y:l x:l v:l", """
SELECT tile_id, y, x, trunc(coalesce((v - lo) * 255.0::DOUBLE / nullif(hi - lo, 0), 0)) AS v
FROM px JOIN (SELECT tile_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY tile_id) USING (tile_id)""")
def _(s):
    return raster.minmax_u8(s.px)


@query("sc08_legacy_level", "image:l level:l used:l", "SELECT image, level, greatest(0, ceil(log2(least(h, w) / 2000))) AS used FROM levels")
def _(s):
    return s.levels.withColumn("used", F.greatest(F.lit(0), F.ceil(F.log2(F.least("h", "w") / 2000)).cast("int")))


@query("sc09_level_before_small", "image:l level:l", """
SELECT image, greatest(0, coalesce(min(level) FILTER (WHERE least(h, w) < 3000) - 1, max(level))) AS level FROM levels GROUP BY image""")
def _(s):
    return raster.level_before_small(s.levels, 3000)


@query("sc10_lazy_level", "y:l x:l v:l", "SELECT * FROM big WHERE y < 40")
def _(s):
    path, _ = s.file_of(s.big, 64)
    s.spark.dataSource.register(images.ImageSource)
    return s.spark.read.format("tissue_image").option("path", path).option("rows", "16").option("y1", "40").load()


@query("sc11_crop", "y:l x:l v:l", "SELECT * FROM big WHERE y BETWEEN 10 AND 29 AND x BETWEEN 5 AND 34")
def _(s):
    return raster.crop(s.big, 5, 10, 30, 20)


@query("sc12_image_or_none", "tile_id:l n:l total:l", "SELECT tile_id, count(*) AS n, sum(v) AS total FROM px WHERE tile_id % 5 <> 0 GROUP BY tile_id")
def _(s):
    files = images.encode_png(s.px)
    broken = files.withColumn("content", F.when(F.col("path").cast("long") % 5 == 0, F.lit(b"broken")).otherwise(F.col("content")))
    return images.decode_files(broken, missing="skip").groupBy(F.col("image_id").cast("long").alias("tile_id")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("sc13_mask_polarity", "tile_id:l y:l x:l fg:l", "SELECT tile_id, y, x, CAST(v < 128 AS INTEGER) AS fg FROM px")
def _(s):
    return raster.mask_from_dark(s.px)


@query("sc14_glob", "vec_id:l path:s", "SELECT vec_id, path FROM names WHERE path LIKE '%\\_dapi\\_mask.png' ESCAPE '\\' ORDER BY path")
def _(s):
    return s.names.where(F.col("path").endswith("_dapi_mask.png")).orderBy("path")


@query("sc15_cells_scan", "cell_id:l x_centroid:d y_centroid:d kind:s", "SELECT * FROM cells")
def _(s):
    folder = scratch(s.spark)
    s.cells.write.option("header", True).option("compression", "gzip").csv(folder)
    return artefacts.read_cells(s.spark, folder)


@query("sc16_ome_meta", "n_nationkey:l pixel_x:d pixel_y:d origin_x:d origin_y:d", """
SELECT n_nationkey, 0.2 + n_nationkey / 100 AS pixel_x, 0.25 AS pixel_y, n_nationkey * 3 AS origin_x, 7 AS origin_y FROM nation""")
def _(s):
    n = F.col("n_nationkey")
    xml = F.format_string('<OME><Plate><Well><WellSample PositionX="%d" PositionY="7"/></Well></Plate><Image><Pixels PhysicalSizeX="%.4f" PhysicalSizeY="0.25"/></Image></OME>', n * 3, lit(0.2) + n / 100)
    return s.table("nation").select(n, xml.alias("xml")).select("n_nationkey", *[c.alias(k) for k, c in artefacts.ome_meta(F.col("xml")).items()])


@query("sc17_json_scan", "event_id:l k:l", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s):
    return s.table("events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("sc18_override_lines", "tile_id:s nucleus_id:l image_kind:s x:l y:l", """
SELECT CAST(tile_id AS VARCHAR) AS tile_id, nucleus_id, kind AS image_kind, x, y FROM (
  SELECT *, row_number() OVER (PARTITION BY tile_id, nucleus_id, kind ORDER BY seq DESC) AS rn FROM overrides WHERE seq % 7 > 1) WHERE rn = 1""")
def _(s):
    from ..operators.manual import last_of_key

    seq = F.col("seq")
    xy = F.when(seq % 7 == 1, F.array(F.col("x").cast("int"))).otherwise(F.array(F.col("x").cast("int"), F.col("y").cast("int")))
    row = F.to_json(F.struct(F.col("tile_id").cast("string").alias("tile_id"), F.col("nucleus_id").cast("int").alias("nucleus_id"), F.col("kind").alias("image_kind"), xy.alias("manual_centroid_xy")))
    lines = s.overrides.select("seq", F.when(seq % 7 == 0, F.lit("{broken")).otherwise(row).alias("line"))
    got = artefacts.parsed_overrides(lines)
    last = last_of_key(got, ("tile_id", "nucleus_id", "image_kind"))
    return last.withColumns({"x": F.col("manual_centroid_xy")[0], "y": F.col("manual_centroid_xy")[1]})


@query("sc19_parameters", "n_nationkey:l off:d thr:d", """
SELECT n_nationkey, greatest(-100, least(100, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey * 20 WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 5 END)) AS off,
  least(1, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 10 ELSE 0.4 END) AS thr FROM nation""")
def _(s):
    n = F.col("n_nationkey")
    pilot = F.when(n % 4 == 0, F.format_string('{"off": %d}', n * 20)).when(n % 4 == 1, '{"off": "None"}').when(n % 4 == 2, '{"off": [1]}').otherwise("{}")
    params = F.when(n % 3 == 0, F.format_string('{"thr": %.3f, "off": 5}', n / 10)).otherwise('{"off": 5}')
    return s.table("nation").select(n, artefacts.prioritised(pilot, params, "off", 0, -100, 100).alias("off"), artefacts.prioritised(F.lit("{}"), params, "thr", 0.4, 0, 1).alias("thr"))


@query("sc20_alias_threshold", "n_nationkey:l thr:d", """
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey WHEN 1 THEN n_nationkey * 2 ELSE 1000 END AS thr FROM nation""")
def _(s):
    n = F.col("n_nationkey")
    j = F.when(n % 3 == 0, F.format_string('{"DAPI_LUT_threshold": %d}', n)).when(n % 3 == 1, F.format_string('{"lut_threshold": %d}', n * 2)).otherwise("{}")
    v = artefacts.first_key(j, ["DAPI_LUT_threshold", "lut_threshold"])
    return s.table("nation").select(n, F.coalesce(v.try_cast("double"), lit(1000)).alias("thr"))


@query("sc21_alignment_priority", "run_id:l priority:l n:l", """
SELECT n_regionkey AS run_id, min(n_nationkey % 3) AS priority, CAST(arg_min(n_nationkey, (n_nationkey % 3) * 1000 + n_nationkey) AS BIGINT) AS n FROM nation GROUP BY n_regionkey""")
def _(s):
    rows = s.table("nation").select(F.col("n_regionkey").alias("run_id"), (F.col("n_nationkey") % 3).alias("priority"), F.col("n_nationkey").alias("n"))
    return artefacts.first_source(rows, "run_id", "priority")


@query("sc22_transform_scan", "n_nationkey:l m02:d m20:d m22:d", """
SELECT n_nationkey, n_nationkey + 0.5 AS m02, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 0.001 END AS m20, 1 AS m22 FROM nation""")
def _(s):
    n = F.col("n_nationkey")
    two = F.format_string("[[1.0,0.0,%.1f],[0.0,1.0,2.0]]", n + lit(0.5))
    three = F.format_string("[[1.0,0.0,%.1f],[0.0,1.0,2.0],[0.001,0.0,1.0]]", n + lit(0.5))
    m = artefacts.matrix3(F.when(n % 2 == 0, two).otherwise(three))
    return s.table("nation").select(n, m.alias("m")).select("n_nationkey", F.col("m")[2].alias("m02"), F.col("m")[6].alias("m20"), F.col("m")[8].alias("m22"))


@query("sc23_flat_tps_keys", "n_nationkey:l i:l x:d w:d", """
SELECT n_nationkey, i, n_nationkey + i AS x, i * 0.5 AS w FROM nation, (SELECT unnest(range(0, 3)) AS i)""")
def _(s):
    n = F.col("n_nationkey")
    j = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array((n + i).cast("double"), lit(0))).alias("tps_ctrl"),
                           F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(i * lit(0.5), lit(0))).alias("tps_w")))
    r = F.from_json(j, "tps_ctrl array<array<double>>, tps_w array<array<double>>")
    rows = s.table("nation").select(n, F.posexplode(F.arrays_zip(r["tps_ctrl"].alias("c"), r["tps_w"].alias("w"))).alias("i", "z"))
    return rows.select("n_nationkey", "i", F.col("z.c")[0].alias("x"), F.col("z.w")[0].alias("w"))


@query("sc24_lut_scan", "i:l r:l g:l b:l", "SELECT i, i AS r, 255 - i AS g, (i * 3) % 256 AS b FROM (SELECT unnest(range(0, 256)) AS i)")
def _(s):
    table = bytes([*range(256), *range(255, -1, -1), *[i * 3 % 256 for i in range(256)]])
    one = s.spark.range(1).select(F.lit(table).alias("content"))
    return one.select(F.explode(images.lut_rows(F.col("content"))).alias("e")).select("e.*")


@query("sc25_cached_view", "tile_id:l n:l", "SELECT tile_id, count(*) AS n FROM px GROUP BY tile_id")
def _(s):
    folder = scratch(s.spark)
    for _ in range(2):  # built the first time, read the second
        base = artefacts.read_or_build(s.spark, folder, lambda: s.px)
    return base.groupBy("tile_id").agg(F.count("*").alias("n"))


@query("sc26_level_factors", "image:l level:l patch:l to_level0:d tile_to_patch:d", """
SELECT image, level, greatest(0, level - 1) AS patch, pow(2, level) AS to_level0, pow(2, level - greatest(0, level - 1)) AS tile_to_patch FROM levels""")
def _(s):
    p = geometry.patch_level(F.col("level"))
    return s.levels.select("image", "level", p.alias("patch"), F.pow(lit(2), F.col("level")).alias("to_level0"), F.pow(lit(2), F.col("level") - p).alias("tile_to_patch"))


_CLAMP = """SELECT tile_id, greatest(0, least({w}, round_even(x0 * {s}, 0))) AS cx0, greatest(0, least({h}, round_even(y0 * {s}, 0))) AS cy0,
 greatest(0, least({w}, round_even((x0 + w) * {s}, 0))) AS cx1, greatest(0, least({h}, round_even((y0 + h) * {s}, 0))) AS cy1 FROM tiles"""


@query("sk01_intensity_tiles", "tile_id:l cx0:l cy0:l cx1:l cy1:l", f"SELECT * FROM ({_CLAMP.format(w=300, h=250, s=0.5)}) WHERE cx1 > cx0 AND cy1 > cy0")
def _(s):
    return geometry.clamped(s.tiles, 300, 250, 0.5)


@query("sk02_lut_tiles", "tile_id:l n:l total:l", f"""
SELECT tile_id, count(*) AS n, sum(v) AS total FROM ({_CLAMP.format(w=64, h=500, s=0.25)}) t JOIN big ON big.x >= cx0 AND big.x < cx1 AND big.y >= cy0 AND big.y < cy1 GROUP BY tile_id""")
def _(s):
    t = geometry.clamped(s.tiles, 64, 500, 0.25).select("tile_id", "cx0", "cy0", "cx1", "cy1")
    cells = t.withColumn("y", F.explode(F.sequence("cy0", F.col("cy1") - 1)))
    rows = s.big.withColumn("y", F.col("y").cast("long")).join(cells, "y").where("x >= cx0 and x < cx1")
    return rows.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


_H = HOMOGRAPHY


def _quad_sql(x: str, y: str, k: int) -> str:
    a, b, c = _H[k]
    g, h, i = _H[2]
    w = f"({g}::DOUBLE * ({x}) + {h}::DOUBLE * ({y}) + {i})"
    return f"({a}::DOUBLE * ({x}) + {b}::DOUBLE * ({y}) + {c}) / {w}"


@query("sk03_he_quads", "tile_id:l qx0:d qy0:d qx2:d qy2:d w:l h:l", f"""
SELECT tile_id, qx0, qy0, qx2, qy2,
 greatest(2, round_even((sqrt(pow(qx1 - qx0, 2) + pow(qy1 - qy0, 2)) + sqrt(pow(qx2 - qx3, 2) + pow(qy2 - qy3, 2))) / 2, 0)) AS w,
 greatest(2, round_even((sqrt(pow(qx3 - qx0, 2) + pow(qy3 - qy0, 2)) + sqrt(pow(qx2 - qx1, 2) + pow(qy2 - qy1, 2))) / 2, 0)) AS h
FROM (SELECT tile_id, {", ".join(f"{_quad_sql(f'ex + ew * {u}', f'ey + eh * {v}', k)} AS q{'xy'[k]}{i}" for i, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for k in (0, 1))}
FROM (SELECT tile_id, x0 - w * 0.2::DOUBLE AS ex, y0 - h * 0.2::DOUBLE AS ey, w + 2 * (w * 0.2::DOUBLE) AS ew, h + 2 * (h * 0.2::DOUBLE) AS eh FROM tiles))""")
def _(s):
    q = geometry.quads(geometry.expanded(s.tiles, 0.2), _H)
    w, h = geometry.rectified_size(geometry.quad_points())
    return q.withColumns({"w": w, "h": h})


@query("sk04_he0_tiles", "tile_id:l cx0:l cy0:l cx1:l cy1:l", f"SELECT * FROM ({_CLAMP.format(w=900, h=700, s=2)}) WHERE cx1 > cx0 AND cy1 > cy0")
def _(s):
    return geometry.clamped(s.tiles, 900, 700, 2)


@query("sk05_points_json", "pid:l json:s", """SELECT pid, '{"x":' || CAST(floor(x) AS BIGINT) || ',"y":' || CAST(floor(y) AS BIGINT) || '}' AS json FROM pts""")
def _(s):
    return s.pts.select("pid", F.to_json(F.struct(F.floor("x").alias("x"), F.floor("y").alias("y"))).alias("json"))


@query("sk06_standout_json", "pair_id:l json:s", """
SELECT pair_id, '{"a":' || a || ',"b":' || b || ',"inter":' || inter || '}' AS json FROM pairs WHERE least(cov_a, cov_b) >= 0.4""")
def _(s):
    from ..operators.masks import overlap_pairs

    p = overlap_pairs(s.ra, s.rb, 0.4, ("pair_id",))
    return p.select("pair_id", F.to_json(F.struct("a", "b", "inter")).alias("json"))


@query("sk07_patch_boxes", "pid:l px0:l py0:l px1:l py1:l", """
SELECT pid, greatest(0, cx - 32) AS px0, greatest(0, cy - 32) AS py0, least(1500, cx + 32) AS px1, least(1200, cy + 32) AS py1
FROM (SELECT pid, greatest(0, least(1499, CAST(round_even(sx / 2, 0) AS BIGINT))) AS cx, greatest(0, least(1199, CAST(round_even(sy / 2, 0) AS BIGINT))) AS cy FROM anchors)""")
def _(s):
    return s.anchors.withColumns(geometry.patch_box(F.col("sx") / 2, F.col("sy") / 2, 64, 1500, 1200))


@query("sk08_centroid_json", "json:s", """
SELECT '{"meta":{"level":1},"data":[' || string_agg('{"pid":' || pid || ',"tile_id":' || tile_id || '}', ',' ORDER BY pid) || ']}' AS json FROM anchors""")
def _(s):
    return artefacts.wrapped(s.anchors.select("pid", "tile_id"), {"level": 1}, "pid")


@query("sk09_transform_csv", "line:l text:s", """
SELECT n_nationkey AS line, printf('%.10f', n_nationkey / 7) || ',' || printf('%.10f', n_nationkey * 1.5) AS text FROM nation WHERE n_nationkey < 3""")
def _(s):
    n = F.col("n_nationkey")
    return s.table("nation").where(n < 3).select(n.alias("line"), F.format_string("%.10f,%.10f", n / 7, n * lit(1.5)).alias("text"))


@query("sk10_images_info", "image:l json:s", """SELECT image, '{"level":' || max(level) || ',"h":' || max(h) || '}' AS json FROM levels GROUP BY image""")
def _(s):
    g = s.levels.groupBy("image").agg(F.max("level").alias("level"), F.max("h").cast("long").alias("h"))
    return g.select("image", F.to_json(F.struct("level", "h")).alias("json"))


@query("sk11_level0_lift", "i:l j:l v:d", """
SELECT i, j, v FROM (VALUES (0, 0, 1.02 * 0.5), (0, 1, -0.03 * 0.5), (0, 2, 40 * 2), (1, 0, 0.02 * 0.5), (1, 1, 0.98 * 0.5), (1, 2, -25 * 2), (2, 0, 0), (2, 1, 0), (2, 2, 1)) t(i, j, v)""")
def _(s):
    m = level0(ANCHOR_MAP, 2, 1)
    return s.spark.createDataFrame([(i, j, m[i][j]) for i in range(3) for j in range(3)], "i int, j int, v double")


@query("sk12_mask_info", "n_nationkey:l json:s", """SELECT n_nationkey, '{"mask_scale":{"dapi":2,"he":' || (1 + n_nationkey % 2) || '}}' AS json FROM nation""")
def _(s):
    he = (1 + F.col("n_nationkey") % 2).alias("he")
    return s.table("nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.lit(2).alias("dapi"), he).alias("mask_scale"))).alias("json"))


@query("sk13_pyramid_export", "tile_id:l level:l n:l total:l", """
SELECT tile_id, 0 AS level, count(*) AS n, sum(v) AS total FROM px GROUP BY tile_id UNION ALL
SELECT tile_id, 1 AS level, count(*) AS n, sum(v) AS total FROM px WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY tile_id""")
def _(s):
    import pandas as pd

    def export(pdf):
        a = np.zeros((8, 8), dtype=np.uint16)
        a[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"path": [str(pdf["tile_id"].iloc[0])], "content": [images.write_tiff([a, a[::2, ::2]], packed_lzw=True, description=artefacts.ome_xml(0.2125, 0.2125))]})

    files = s.px.groupBy("tile_id").applyInPandas(export, "path string, content binary")
    both = images.decode_files(files, 0).unionByName(images.decode_files(files, 1))
    return both.groupBy(F.col("image_id").cast("long").alias("tile_id"), "level").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("sk14_export_plan", "tile_id:l sx0:l sy0:l sx1:l sy1:l", f"""
SELECT * FROM (SELECT tile_id, greatest(0, least(3000, floor(least(qx0, qx1, qx2, qx3)) - 2)) AS sx0, greatest(0, least(2000, floor(least(qy0, qy1, qy2, qy3)) - 2)) AS sy0,
 greatest(0, least(3000, ceil(greatest(qx0, qx1, qx2, qx3)) + 2)) AS sx1, greatest(0, least(2000, ceil(greatest(qy0, qy1, qy2, qy3)) + 2)) AS sy1
FROM (SELECT tile_id, {", ".join(f"{_quad_sql(f'x0 + w * {u}', f'y0 + h * {v}', k)} AS q{'xy'[k]}{i}" for i, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for k in (0, 1))}
FROM (SELECT i * 5 + j AS tile_id, j * 1024 AS x0, i * 1024 AS y0, least(1024, 4500 - j * 1024) AS w, least(1024, 3500 - i * 1024) AS h
 FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 5)) AS j)))) WHERE sx1 > sx0 AND sy1 > sy0""")
def _(s):
    return geometry.source_windows(geometry.tile_grid(s.spark, 4500, 3500, 1024), _H, 3000, 2000)


@query("sk15_comparison_frames", "pair_id:l frame:l y:l x:l v:l", """
SELECT pair_id, 0 AS frame, y, x, CASE WHEN y = 7 AND x > 4 THEN 255 ELSE v END AS v FROM ma UNION ALL SELECT pair_id, 1, y, x, CASE WHEN y = 7 AND x > 4 THEN 255 ELSE v END FROM mb""")
def _(s):
    return raster.comparison_frames(s.ma, s.mb, raster.corner_mark(SIDE, SIDE, 3))


@query("sk16_extent", "w:l h:l", "SELECT ceil(max(x)) AS w, ceil(max(y)) AS h FROM pts")
def _(s):
    return s.pts.agg(F.ceil(F.max("x")).alias("w"), F.ceil(F.max("y")).alias("h"))


@query("sk17_event_append", "event_id:l stage:s event:s", "SELECT event_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS event FROM events")
def _(s):
    e = s.table("events").select("event_id", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("finish").alias("event"))
    folder = scratch(s.spark)
    for event in ("start", "finish"):
        artefacts.append_event(s.spark, e.where(F.col("event") == event), folder)
    return s.spark.read.schema(e.schema).json(folder)


@query("sk18_pilot_params", "event_id:l snapped:l threshold:d", "SELECT event_id, CAST(round_even(floor(value) / 5, 0) AS BIGINT) * 5 AS snapped, floor(value) AS threshold FROM events")
def _(s):
    p = artefacts.snapped_params(F.floor("value").cast("double"), F.floor("value").cast("double"))
    return s.table("events").select("event_id", p["offset"].alias("snapped"), p["threshold"].alias("threshold"))


@query("sk19_move_dropped", "tile_id:l nucleus:l dropped:b", "SELECT tile_id, nucleus, nucleus % 13 = 0 AS dropped FROM anchors")
def _(s):
    kept, gone = scratch(s.spark), scratch(s.spark)
    rows = s.anchors.select("tile_id", "nucleus")
    artefacts.move_dropped(rows, rows.where("nucleus % 13 = 0"), ("tile_id", "nucleus"), kept, gone)
    moved = s.spark.read.parquet(gone).drop("dropped_at").withColumn("dropped", F.lit(True))
    return s.spark.read.parquet(kept).withColumn("dropped", F.lit(False)).unionByName(moved)


@query("sk20_restore_version", "tile_id:l nucleus_id:l x:d", """
SELECT tile_id, nucleus_id, x FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, nucleus_id, kind ORDER BY seq) AS rn FROM overrides) WHERE rn = 1 AND kind = 'he'""")
def _(s):
    from ..operators.manual import last_of_key

    folder, he = scratch(s.spark), s.overrides.where("kind = 'he'")
    first = he.groupBy("tile_id", "nucleus_id").agg(F.min(F.struct("seq", "x")).alias("r"))
    first, last = first.select("tile_id", "nucleus_id", F.col("r.x").alias("x")), last_of_key(he).select("tile_id", "nucleus_id", "x")
    for version, rows in ((0, first), (1, last), (0, last)):  # a version that is there stays as it is
        artefacts.snapshot(rows, folder, version)
    return artefacts.restore(s.spark, folder, 0)


_HEIGHT = "(SELECT max(y) + 1 FROM slide)"
_INSIDE = "x >= cx0 AND x < cx1 AND y >= cy0 AND y < cy1"


def _sums(files, *more):
    """Rows and sum of the pixels of PNG files named after their tile."""
    px = images.decode_files(files).withColumn("tile_id", F.regexp_extract("image_id", r"tile_(\d+)[^/]*$", 1).cast("long"))
    return px.groupBy("tile_id", *more).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _put(s, tiles, end: str):
    """The folder that tiles were written to, and its files."""
    folder = scratch(s.spark)
    export.write_files(tiles.select(F.format_string(f"tile_%03d_{end}.png", "tile_id").alias("path"), "content"), folder)
    return s.spark.read.format("binaryFile").option("pathGlobFilter", f"*_{end}.png").load(folder)


@query("sk01_tile_files", "tile_id:l n:l total:l preview:l", f"""
SELECT tile_id, count(*) AS n, sum(deep) AS total, sum(trunc(round((deep - lo) * 255.0::DOUBLE / (hi - lo + 1e-8::DOUBLE), 9))) AS preview
FROM (SELECT tile_id, deep, min(deep) OVER w AS lo, max(deep) OVER w AS hi FROM ({_CLAMP.format(w=SLIDE_WIDTH, h=_HEIGHT, s=0.5)}) t JOIN whole ON {_INSIDE}
 WINDOW w AS (PARTITION BY tile_id)) GROUP BY tile_id""")
def _(s):
    path, h = s.file_of(s.slide, SLIDE_WIDTH, ("deep",), 16)
    boxes = geometry.clamped(s.tiles, SLIDE_WIDTH, h, 0.5)
    whole, preview = (_sums(_put(s, export.cut(boxes, path, preview=p), end)) for p, end in ((False, "dapi_u16"), (True, "dapi_u8")))
    return whole.join(preview.select("tile_id", F.col("total").alias("preview")), "tile_id")


@query("sk02_lut_files", "tile_id:l n:l total:l", f"""
SELECT tile_id, 3 * count(*) AS n, sum(v + g + b) AS total FROM ({_CLAMP.format(w=SLIDE_WIDTH, h=_HEIGHT, s=0.25)}) t JOIN whole ON {_INSIDE} GROUP BY tile_id""")
def _(s):
    path, h = s.file_of(s.slide, SLIDE_WIDTH, ("v", "g", "b"))
    return _sums(_put(s, export.cut(geometry.clamped(s.tiles, SLIDE_WIDTH, h, 0.25), path), "dapi"))


def _bilinear_sql(places: str, key: str) -> str:
    """The three colours summed over bilinear samples of the slide at places (key, i, j, sx, sy)."""
    parts = " + ".join(f"round_even(round(sum(f * coalesce({c}, 0)), 9), 0)" for c in ("v", "g", "b"))
    return f"""SELECT {key}, 3 * count(*) AS n, sum(t) AS total FROM (SELECT {key}, i, j, {parts} AS t FROM
 (SELECT {key}, i, j, CAST(floor(sx) AS BIGINT) + dx AS x, CAST(floor(sy) AS BIGINT) + dy AS y,
  CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS f
  FROM ({places}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy)) LEFT JOIN slide USING (x, y) GROUP BY {key}, i, j) GROUP BY {key}"""


_EXPANDED = f"""SELECT *, greatest(2, round_even((sqrt(pow(qx1 - qx0, 2) + pow(qy1 - qy0, 2)) + sqrt(pow(qx2 - qx3, 2) + pow(qy2 - qy3, 2))) / 2, 0)) AS rw,
 greatest(2, round_even((sqrt(pow(qx3 - qx0, 2) + pow(qy3 - qy0, 2)) + sqrt(pow(qx2 - qx1, 2) + pow(qy2 - qy1, 2))) / 2, 0)) AS rh
FROM (SELECT *, {", ".join(f"{_quad_sql(f'ex + ew * {u}', f'ey + eh * {v}', k)} AS q{'xy'[k]}{i}" for i, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for k in (0, 1))}
FROM (SELECT tile_id, x0 - w * 0.2::DOUBLE AS ex, y0 - h * 0.2::DOUBLE AS ey, w + 2 * (w * 0.2::DOUBLE) AS ew, h + 2 * (h * 0.2::DOUBLE) AS eh FROM tiles))
WHERE least(qx0, qx1, qx2, qx3) < {SLIDE_WIDTH} AND greatest(qx0, qx1, qx2, qx3) > 0 AND least(qy0, qy1, qy2, qy3) < {_HEIGHT} AND greatest(qy0, qy1, qy2, qy3) > 0"""
_PLACES = f"""SELECT tile_id, i, j, {_quad_sql("px0", "py0", 0)} AS sx, {_quad_sql("px0", "py0", 1)} AS sy FROM
(SELECT tile_id, i, j, ex + (j::DOUBLE / (rw - 1)) * ew AS px0, ey + (i::DOUBLE / (rh - 1)) * eh AS py0 FROM
 (SELECT *, unnest(range(0, rw::BIGINT)) AS j FROM (SELECT *, unnest(range(0, rh::BIGINT)) AS i FROM ({_EXPANDED}))))"""


@query("sk03_he_files", "tile_id:l n:l total:l", _bilinear_sql(_PLACES, "tile_id"))
def _(s):
    path, _ = s.file_of(s.slide, SLIDE_WIDTH, ("v", "g", "b"))
    return _sums(_put(s, export.rectified(geometry.expanded(s.tiles, 0.2), path, _H), "he"))


@query("sk04_he0_files", "tile_id:l n:l total:l", f"""
SELECT tile_id, 3 * count(*) AS n, sum(v + g + b) AS total FROM ({_CLAMP.format(w=SLIDE_WIDTH, h=_HEIGHT, s=2)}) t JOIN whole ON {_INSIDE} GROUP BY tile_id""")
def _(s):
    path, h = s.file_of(s.slide, SLIDE_WIDTH, ("v", "g", "b"))
    return _sums(_put(s, export.cut(geometry.clamped(s.tiles, SLIDE_WIDTH, h, 2), path), "he0"))


@query("sk07_patch_files", "pid:l n:l total:l", f"""
SELECT pid, count(*) AS n, sum(deep) AS total FROM (SELECT pid, x, unnest(range(greatest(0, cy - 4), least(h, cy + 4))) AS y FROM
 (SELECT *, unnest(range(greatest(0, cx - 4), least({SLIDE_WIDTH}, cx + 4))) AS x FROM
  (SELECT pid, h, greatest(0, least({SLIDE_WIDTH - 1}, CAST(round_even(sx / 5, 0) AS BIGINT))) AS cx, greatest(0, least(h - 1, CAST(round_even(sy / 30, 0) AS BIGINT))) AS cy
   FROM anchors, (SELECT max(y) + 1 AS h FROM slide)))) JOIN whole USING (x, y) GROUP BY pid""")
def _(s):
    path, h = s.file_of(s.slide, SLIDE_WIDTH, ("deep",), 16)
    boxes = s.anchors.withColumns(geometry.patch_box(F.col("sx") / 5, F.col("sy") / 30, 8, SLIDE_WIDTH, h))
    patches = export.cut(boxes, path, keep=["pid"], box=("px0", "py0", "px1", "py1"))
    px = images.decode_files(patches.select(F.col("pid").cast("string").alias("path"), "content"))
    return px.groupBy(F.col("image_id").cast("long").alias("pid")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("sk14_registered_file", "tile_id:l n:l total:l", _bilinear_sql(f"""
SELECT tile_id, i, j, {_quad_sql("j::DOUBLE", "i::DOUBLE", 0)} AS sx, {_quad_sql("j::DOUBLE", "i::DOUBLE", 1)} AS sy FROM
 (SELECT i // 64 * 9 + j // 64 AS tile_id, i, j FROM (SELECT unnest(range(0, 530)) AS j), (SELECT unnest(range(0, {_HEIGHT} + 10)) AS i))""", "tile_id"))
def _(s):
    source, h = s.file_of(s.slide, SLIDE_WIDTH, ("v", "g", "b"))
    grid = geometry.tile_grid(s.spark, 530, h + 10, 64).repartition(8)
    out = scratch(s.spark)
    s.spark.range(0).write.parquet(out)
    path = export.write_big_tiff(export.registered(grid, source, _H, 64), f"{out}/registered.ome.tif", 530, h + 10, 64, 3, 8, artefacts.ome_xml(0.2125, 0.2125))
    s.spark.dataSource.register(images.ImageSource)
    px = s.spark.read.format("tissue_image").option("path", path).option("rows", "64").load()
    return px.groupBy((F.floor(F.col("y") / 64) * 9 + F.floor(F.col("x") / 64)).alias("tile_id")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
