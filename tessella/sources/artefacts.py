"""JSON, CSV and XML artefacts: tolerant reads, parameters, transforms; writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_even

MATRIX_KEYS = ("H_mat", "H_homo", "H", "h_mat", "H_matrix", "homography_3x3")
OVERRIDE_DDL = "tile_id string, nucleus_id int, image_kind string, manual_centroid_xy array<int>, time string"


def read_cells(spark: SparkSession, path: str, required: Sequence[str] = ("x_centroid", "y_centroid")) -> DataFrame:
    """Cell table from (gzipped) CSV with a header; centroids as doubles, other columns as text."""
    cells = spark.read.option("header", True).csv(path)
    gone = [c for c in required if c not in cells.columns]
    if gone:
        raise ValueError(f"{path} lacks {', '.join(gone)}")
    return cells.withColumns({c: F.col(c).cast("double") for c in required})


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override log from JSON lines; blank and corrupt lines and records without two coordinates go."""
    rows = spark.read.schema(OVERRIDE_DDL).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.size("manual_centroid_xy") == 2)


def parsed_overrides(lines: DataFrame, col: str = "line") -> DataFrame:
    """The same from a column of lines."""
    r = F.from_json(col, OVERRIDE_DDL)
    return lines.withColumn("_r", r).where(F.size("_r.manual_centroid_xy") == 2).select(*[c for c in lines.columns if c != col], "_r.*")


def first_key(json: Column, keys: Sequence[str]) -> Column:
    """The first of several keys that a JSON object has, as text."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def number(json: Column, key: str, default: float, low: float | None = None, high: float | None = None) -> Column:
    """A numeric parameter: absent, null, "None" or ill-typed gives the default; then limits hold."""
    raw = F.nullif(F.get_json_object(json, f"$.{key}"), F.lit("None"))
    v = F.coalesce(raw.try_cast("double"), F.lit(float(default)))
    return clamp(v, float(low), float(high)) if low is not None else v


def prioritised(pilot: Column, params: Column, key: str, default: float, low: float, high: float) -> Column:
    """Pilot value, else parameter, else default; limited."""
    values = [F.nullif(F.get_json_object(j, f"$.{key}"), F.lit("None")).try_cast("double") for j in (pilot, params)]
    return clamp(F.coalesce(*values, F.lit(float(default))), float(low), float(high))


def first_source(sources: DataFrame, key: str, priority: str) -> DataFrame:
    """The row of best priority for each key."""
    rest = [c for c in sources.columns if c not in (key, priority)]
    best = sources.groupBy(key).agg(F.min(F.struct(priority, *rest)).alias("_r"))
    return best.select(key, f"_r.{priority}", *[f"_r.{c}" for c in rest])


def ome_meta(xml: Column) -> dict[str, Column]:
    """Origin and pixel size from OME-XML text."""
    return {
        "pixel_x": F.xpath_double(xml, F.lit("//Pixels/@PhysicalSizeX")), "pixel_y": F.xpath_double(xml, F.lit("//Pixels/@PhysicalSizeY")),
        "origin_x": F.xpath_double(xml, F.lit("//WellSample/@PositionX")), "origin_y": F.xpath_double(xml, F.lit("//WellSample/@PositionY")),
    }


def matrix3(flat: Column) -> Column:
    """A JSON matrix of two or three rows, as nine numbers; two rows get [0, 0, 1] below."""
    v = F.flatten(F.from_json(flat, "array<array<double>>"))
    return F.when(F.size(v) == 6, F.concat(v, F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0)]))).when(F.size(v) == 9, v)


def wrapped(rows: DataFrame, meta: dict[str, object], order: str) -> DataFrame:
    """One JSON text {meta, data} of bounded tables such as the centroids of a run."""
    head = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()])
    data = F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))
    return rows.agg(F.to_json(F.struct(head.alias("meta"), data.alias("data"))).alias("json"))


def matrix_csv(m: Sequence[Sequence[float]]) -> str:
    return "\n".join(",".join(f"{v:.10f}" for v in row) for row in m)


def snapped_params(offset: Column, threshold: Column) -> dict[str, Column]:
    """Pilot parameters as saved: offset to the nearest 5, threshold to two decimals."""
    return {"offset": (half_even(offset / 5) * 5).cast("long"), "threshold": half_even(threshold, 2)}


def append_event(spark: SparkSession, events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is read if a whole one is there, and built and written first if not."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ome_xml(size_x: float, size_y: float, unit: str = "um") -> str:
    """The part of an OME description that ``ome_meta`` reads: the size of a pixel."""
    return f'<OME><Image><Pixels PhysicalSizeX="{size_x}" PhysicalSizeY="{size_y}" PhysicalSizeXUnit="{unit}" PhysicalSizeYUnit="{unit}"/></Image></OME>'


def existing(manifest: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Which of the wanted files a manifest has."""
    return wanted.join(manifest.select(key).distinct(), key, "left_semi")


def write_tiles(pixels: DataFrame, path: str, key: str = "tile_id") -> None:
    """Pixel rows in one folder a tile."""
    pixels.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def move_dropped(rows: DataFrame, keys: DataFrame, key: Sequence[str], kept_path: str, dropped_path: str) -> None:
    """Rewrite the kept rows, and put the dropped ones with a time stamp beside them."""
    k = keys.select(*key).distinct()
    rows.join(k, list(key), "left_semi").withColumn("dropped_at", F.current_timestamp()).write.mode("append").parquet(dropped_path)
    rows.join(k, list(key), "left_anti").write.mode("overwrite").parquet(kept_path)


def snapshot(rows: DataFrame, path: str, version: int) -> str:
    """A version that later edits can go back to; the first one written stays."""
    where = f"{path}/version={version}"
    rows.write.mode("ignore").parquet(where)
    return where


def restore(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
