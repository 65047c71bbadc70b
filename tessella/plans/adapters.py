"""The driver tables as rasters, cells, anchors, tiles, levels and logs; the same in Spark and in SQL."""

from __future__ import annotations

import atexit
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import drop, scratch
from ..operators.masks import component_stats, row_runs
from ..sources import export

#: Size of a tile made of an embedding, and width of the slide that tiles make.
SIDE, SLIDE_WIDTH = 8, 512

#: The map from tile to target pixels that anchors follow, and an example of each transform.
ANCHOR_MAP = ((1.02, -0.03, 40.0), (0.02, 0.98, -25.0))
HOMOGRAPHY = ((1.01, 0.02, 5.0), (-0.015, 0.99, 3.0), (0.00001, 0.00002, 1.0))
META = {"origin_x": 100.0, "origin_y": 50.0, "pixel_x": 0.2125, "pixel_y": 0.2125}

VIEWS = {
    "px": (
        "SELECT vec_id AS tile_id, i // 8 AS y, i % 8 AS x, "
        "CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.55) * 230))) AS BIGINT) AS v "
        "FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS i FROM embeddings)"
    ),
    "pm": "SELECT *, CAST(v >= median(v) OVER (PARTITION BY tile_id) AS INTEGER) AS fg FROM px",
    "ma": "SELECT tile_id // 2 AS pair_id, y, x, v, fg FROM pm WHERE tile_id % 2 = 0",
    "mb": "SELECT tile_id // 2 AS pair_id, y, x, v, fg FROM pm WHERE tile_id % 2 = 1",
    "big": "SELECT tile_id AS y, y * 8 + x AS x, v FROM px",
    "slide": "SELECT (tile_id // 64) * 8 + y AS y, (tile_id % 64) * 8 + x AS x, v, v * 200 AS deep, 255 - v AS g, (v * 7) % 256 AS b FROM px",
    "whole": (
        "SELECT i // 512 AS y, i % 512 AS x, coalesce(slide.v, 0) AS v, coalesce(deep, 0) AS deep, coalesce(g, 0) AS g, coalesce(b, 0) AS b "
        "FROM (SELECT unnest(range(0, 512 * (SELECT max(y) + 1 FROM slide))) AS i) LEFT JOIN slide ON slide.y = i // 512 AND slide.x = i % 512"
    ),
    "rgb": "SELECT tile_id, y, x, v AS r, 255 - v AS g, (v * 7) % 256 AS b FROM px",
    "cells": (
        "SELECT p_partkey AS cell_id, p_retailprice * 3 + p_size AS x_centroid, "
        "CAST(p_size * 17 + p_partkey % 97 AS DOUBLE) AS y_centroid, p_brand AS kind FROM part"
    ),
    "pts": "SELECT cell_id AS pid, round(x_centroid, 3) AS x, y_centroid AS y FROM cells",
    "spots": "SELECT tile_id AS pid, x0 + w / 2 AS x, y0 + h / 2 AS y FROM tiles",
    "centres": "SELECT CAST(substr(kind, 7) AS BIGINT) AS cid, round(avg(round(x_centroid, 3)), 3) AS cx, round(avg(y_centroid), 3) AS cy FROM cells GROUP BY kind",
    "tiles": (
        "SELECT s_suppkey AS tile_id, CAST((s_suppkey * 37) % 500 - 20 AS DOUBLE) AS x0, "
        "CAST((s_suppkey * 53) % 400 - 20 AS DOUBLE) AS y0, CAST(20 + s_suppkey % 23 AS DOUBLE) AS w, "
        "CAST(15 + s_suppkey % 17 AS DOUBLE) AS h FROM supplier"
    ),
    "anchors": (
        "SELECT o_orderkey AS pid, o_custkey % 36 AS tile_id, o_orderkey AS nucleus, "
        "CAST(o_orderkey % 211 * 10 AS DOUBLE) AS sx, CAST(o_custkey % 173 * 10 AS DOUBLE) AS sy, "
        "1.02::DOUBLE * (o_orderkey % 211 * 10) - 0.03::DOUBLE * (o_custkey % 173 * 10) + 40 + (o_orderkey % 7 - 3) "
        "+ CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 0 END AS dx, "
        "0.02::DOUBLE * (o_orderkey % 211 * 10) + 0.98::DOUBLE * (o_custkey % 173 * 10) - 25 + (o_orderkey % 5 - 2) AS dy "
        "FROM orders"
    ),
    "levels": (
        "SELECT n_regionkey AS image, level, CAST(16000 // (1 << level) AS BIGINT) AS h, CAST(12000 // (1 << level) AS BIGINT) AS w "
        "FROM (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS level FROM nation)"
    ),
    "overrides": (
        "SELECT event_id AS seq, user_id AS tile_id, CAST(floor(value) AS BIGINT) % 2 AS nucleus_id, "
        "CASE WHEN event_id % 2 = 0 THEN 'dapi' ELSE 'he' END AS kind, floor(value) AS x, floor(value * 3) AS y "
        "FROM events WHERE event_type = 'click'"
    ),
    "centroids": (
        "SELECT c_custkey AS tile_id, n AS nucleus_id, CAST(c_custkey * 3 AS DOUBLE) AS dapi_x, CAST(c_custkey % 50 AS DOUBLE) AS dapi_y, "
        "CAST(c_custkey * 2 AS DOUBLE) AS he_x, CAST(c_custkey % 31 AS DOUBLE) AS he_y "
        "FROM customer, (SELECT unnest([0, 1]) AS n)"
    ),
    "results": (
        "SELECT s_suppkey AS tile_id, s_suppkey % 5 AS n_pairs, s_acctbal / 10000 AS score FROM supplier"
    ),
    "names": "SELECT vec_id, 'tile_' || lpad(CAST(vec_id AS VARCHAR), 3, '0') || CASE WHEN vec_id % 3 = 0 THEN '_he.png' ELSE '_dapi_mask.png' END AS path FROM embeddings",
    "runs": (
        "SELECT *, y * 8 + min(x) OVER (PARTITION BY tile_id, y, x - rn) + 1 AS label "
        "FROM (SELECT tile_id, y, x, v, fg, row_number() OVER (PARTITION BY tile_id, y ORDER BY x) AS rn FROM pm WHERE fg = 1)"
    ),
    "comps": (
        "SELECT tile_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 "
        "FROM runs GROUP BY tile_id, label"
    ),
    "ra": "SELECT tile_id // 2 AS pair_id, y, x, label FROM runs WHERE tile_id % 2 = 0",
    "rb": "SELECT tile_id // 2 AS pair_id, y, x, label FROM runs WHERE tile_id % 2 = 1",
    "pairs": (
        "SELECT *, 2 * cov_a * cov_b / (cov_a + cov_b + 1e-6::DOUBLE) AS f1 FROM (SELECT pair_id, a, b, inter, area_a, area_b, "
        "inter / (area_a + 1e-6::DOUBLE) AS cov_a, inter / (area_b + 1e-6::DOUBLE) AS cov_b FROM "
        "(SELECT ra.pair_id, ra.label AS a, rb.label AS b, count(*) AS inter FROM ra JOIN rb ON ra.pair_id = rb.pair_id AND ra.y = rb.y AND ra.x = rb.x GROUP BY ALL) "
        "JOIN (SELECT pair_id, label AS a, count(*) AS area_a FROM ra GROUP BY ALL) USING (pair_id, a) "
        "JOIN (SELECT pair_id, label AS b, count(*) AS area_b FROM rb GROUP BY ALL) USING (pair_id, b))"
    ),
}


class Source:
    """The same adapters as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def blocks(self) -> DataFrame:
        """A row a tile: its values in an array, and their median. No shuffle is needed for either."""
        v = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + F.lit(0.55)) * F.lit(230.0)).cast("int"))))
        rows = self.table("embeddings").select(F.col("vec_id").alias("tile_id"), v.alias("vs"))
        s, n = F.array_sort("vs"), F.size("vs")
        return rows.withColumn("m", (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    def _pixels(self, *more) -> DataFrame:
        e = self.blocks.select("tile_id", "m", F.posexplode("vs").alias("i", "v"))
        return e.select("tile_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), "v", *more)

    @cached_property
    def px(self) -> DataFrame:
        return self._pixels()

    @cached_property
    def pm(self) -> DataFrame:
        return self._pixels((F.col("v") >= F.col("m")).cast("int").alias("fg"))

    def side(self, k: int) -> DataFrame:
        return self.pm.where(F.col("tile_id") % 2 == k).select(F.floor(F.col("tile_id") / 2).alias("pair_id"), "y", "x", "v", "fg")

    @property
    def ma(self) -> DataFrame:
        return self.side(0)

    @property
    def mb(self) -> DataFrame:
        return self.side(1)

    @property
    def big(self) -> DataFrame:
        return self.px.select(F.col("tile_id").alias("y"), (F.col("y") * SIDE + F.col("x")).alias("x"), "v")

    @property
    def slide(self) -> DataFrame:
        """The tiles side by side, 64 to a row, as one image of 8-bit colours (v, g, b) and 16 bits (deep)."""
        v, t = F.col("v"), F.col("tile_id")
        y, x = F.floor(t / 64) * SIDE + F.col("y"), t % 64 * SIDE + F.col("x")
        return self.px.select(y.alias("y"), x.alias("x"), "v", (v * 200).alias("deep"), (255 - v).alias("g"), (v * 7 % 256).alias("b"))

    def file_of(self, pixels: DataFrame, width: int, bands: tuple[str, ...] = ("v",), bits: int = 8, tile: int = 64) -> tuple[str, int]:
        """An image written as a tiled file in the shared folder, and its height."""
        h = int(pixels.agg(F.max("y")).first()[0]) + 1
        path = f"{scratch(self.spark)}.tif"
        atexit.register(drop, self.spark, path)
        return export.write_big_tiff(export.packed_tiles(pixels, width, tile, bands, bits), path, width, h, tile, len(bands), bits), h

    @property
    def rgb(self) -> DataFrame:
        v = F.col("v")
        return self.px.select("tile_id", "y", "x", v.alias("r"), (255 - v).alias("g"), (v * 7 % 256).alias("b"))

    @property
    def cells(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("cell_id"), (F.col("p_retailprice") * 3 + F.col("p_size")).alias("x_centroid"),
            (F.col("p_size") * 17 + F.col("p_partkey") % 97).cast("double").alias("y_centroid"), F.col("p_brand").alias("kind"),
        )

    @property
    def pts(self) -> DataFrame:
        return self.cells.select(F.col("cell_id").alias("pid"), F.round("x_centroid", 3).alias("x"), F.col("y_centroid").alias("y"))

    @property
    def spots(self) -> DataFrame:
        """The middles of the tiles: few points, for operators on all pairs."""
        return self.tiles.select(F.col("tile_id").alias("pid"), (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))

    @property
    def centres(self) -> DataFrame:
        """The mean place of each kind of cell: as many centres as there are kinds."""
        mean = [F.round(F.avg(c), 3).alias(n) for c, n in ((F.round("x_centroid", 3), "cx"), (F.col("y_centroid"), "cy"))]
        return self.cells.groupBy("kind").agg(*mean).select(F.substring("kind", 7, 9).cast("long").alias("cid"), "cx", "cy")

    @property
    def tiles(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("tile_id"), (k * 37 % 500 - 20).cast("double").alias("x0"), (k * 53 % 400 - 20).cast("double").alias("y0"),
            (20 + k % 23).cast("double").alias("w"), (15 + k % 17).cast("double").alias("h"),
        )

    @property
    def anchors(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        x, y = (o % 211 * 10).cast("double"), (c % 173 * 10).cast("double")
        (a, b, e), (d, f, g) = ANCHOR_MAP
        return self.table("orders").select(
            o.alias("pid"), (c % 36).alias("tile_id"), o.alias("nucleus"), x.alias("sx"), y.alias("sy"),
            (F.lit(a) * x + F.lit(b) * y + F.lit(e) + (o % 7 - 3) + F.when(o % 11 == 0, 500).otherwise(0)).alias("dx"),
            (F.lit(d) * x + F.lit(f) * y + F.lit(g) + (o % 5 - 2)).alias("dy"),
        )

    @property
    def levels(self) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
        n = self.table("nation").select(F.col("n_regionkey").alias("image"), n.alias("level"))
        size = F.pow(F.lit(2.0), F.col("level"))
        return n.withColumns({"h": F.floor(16000 / size), "w": F.floor(12000 / size)})

    @property
    def overrides(self) -> DataFrame:
        v = F.col("value")
        return self.table("events").where("event_type = 'click'").select(
            F.col("event_id").alias("seq"), F.col("user_id").alias("tile_id"), (F.floor(v) % 2).alias("nucleus_id"),
            F.when(F.col("event_id") % 2 == 0, "dapi").otherwise("he").alias("kind"), F.floor(v).cast("double").alias("x"), F.floor(v * 3).cast("double").alias("y"),
        )

    @property
    def centroids(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            c.alias("tile_id"), F.col("n").cast("long").alias("nucleus_id"), (c * 3).cast("double").alias("dapi_x"), (c % 50).cast("double").alias("dapi_y"),
            (c * 2).cast("double").alias("he_x"), (c % 31).cast("double").alias("he_y"),
        )

    @property
    def results(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("tile_id"), (F.col("s_suppkey") % 5).alias("n_pairs"), (F.col("s_acctbal") / 10000).alias("score"))

    @property
    def names(self) -> DataFrame:
        end = F.when(F.col("vec_id") % 3 == 0, "_he.png").otherwise("_dapi_mask.png")
        return self.table("embeddings").select("vec_id", F.concat(F.lit("tile_"), F.lpad(F.col("vec_id").cast("string"), 3, "0"), end).alias("path"))

    @property
    def runs(self) -> DataFrame:
        return row_runs(self.pm, SIDE)

    @property
    def comps(self) -> DataFrame:
        return component_stats(self.runs)

    def run_side(self, k: int) -> DataFrame:
        return self.runs.where(F.col("tile_id") % 2 == k).select(F.floor(F.col("tile_id") / 2).alias("pair_id"), "y", "x", "label")

    @property
    def ra(self) -> DataFrame:
        return self.run_side(0)

    @property
    def rb(self) -> DataFrame:
        return self.run_side(1)
