"""Operators over pixel rows (image key, y, x, v): levels, channels, intensity maps, crops, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_even, lit, trunc_int

KEY = ("tile_id",)


def truncated(c: Column) -> Column:
    """To an int towards zero, after rounding away the last digits, which depend on the order of sums."""
    return trunc_int(F.round(c, 9))


def pick_level(levels: DataFrame, min_size: int = 1000, max_size: int = 2000, key: str = "image") -> DataFrame:
    """Per image the first level whose smaller side lies in [min_size, max_size], else level 0."""
    fits = F.least("h", "w").between(min_size, max_size)
    return levels.groupBy(key).agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.lit(0)).alias("level"))


def level_before_small(levels: DataFrame, min_size: int = 1000, key: str = "image") -> DataFrame:
    """Per image the last level before the first whose smaller side is below min_size (the last one if none is)."""
    small = F.when(F.least("h", "w") < min_size, F.col("level"))
    return levels.groupBy(key).agg(F.greatest(F.lit(0), F.coalesce(F.min(small) - 1, F.max("level"))).alias("level"))


def halvings(h: Column, w: Column, max_size: int) -> Column:
    """How often both sides are halved (integer division) until the smaller is at most max_size."""
    side = F.least(h, w)
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.lit(0), lambda n, i: n + (side >= (max_size + 1) * F.pow(F.lit(2.0), i - 1)).cast("int"))


def overview(pixels: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Area-averaged overview, 2**k source pixels to a side."""
    f = 1 << k
    return pixels.groupBy(*key, F.floor(F.col("y") / f).alias("y"), F.floor(F.col("x") / f).alias("x")).agg(F.avg("v").alias("v"))


def infer_axes(shape: Column) -> Column:
    """Axes of a non-OME array from its shape."""
    last = F.element_at(shape, -1)
    return F.when(F.size(shape) == 2, "YX").when((F.size(shape) == 3) & last.isin(3, 4), "YXC").otherwise("CYX")


def channel_plan(axes: Column, n: Column, mode: str | int | None = "auto") -> Column:
    """Which channels are read: "all" or the index of one; null where the mode can't be had."""
    if mode is None:
        return F.lit("all")
    if isinstance(mode, int):
        return F.when((F.lit(mode) >= 0) & (F.lit(mode) < n), F.lit(str(mode)))
    if mode == "dapi":
        return F.lit("0")
    if mode == "he":
        return F.when((axes == "CYX") & (n == 3) | (axes == "YXC") & n.isin(3, 4), F.lit("all"))
    return F.when(axes == "CYX", F.when(n >= 4, "0").otherwise("all")).otherwise(F.when(n.isin(3, 4), "all").otherwise("0"))


def replicated_grey(rgb: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Whether all three channels are equal in every pixel."""
    return rgb.groupBy(*key).agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("grey"))


def minmax_u8(pixels: DataFrame, key: Sequence[str] = KEY, eps: float = 0.0, col: str = "v") -> DataFrame:
    """To 0..255 by the image's minimum and maximum, truncated; a constant image becomes 0."""
    lo, hi = F.min(col), F.max(col)
    span = pixels.groupBy(*key).agg(lo.alias("_lo"), hi.alias("_hi"))
    joined = pixels.join(span, list(key)) if key else pixels.crossJoin(span)
    width = F.col("_hi") - F.col("_lo")
    scaled = (F.col(col) - F.col("_lo")) * lit(255) / ((width + lit(eps)) if eps else F.nullif(width.cast("double"), lit(0)))
    return joined.withColumn(col, truncated(F.coalesce(scaled, lit(0)))).drop("_lo", "_hi")


def crop(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Pixels of a window; the ranges reach the scan as filters."""
    return pixels.where(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1))


def mask_from_dark(pixels: DataFrame, below: int = 128) -> DataFrame:
    """Masks are stored with objects dark: foreground is what is below the limit."""
    return pixels.withColumn("fg", (F.col("v") < below).cast("int"))


def optical_density(c: Column) -> Column:
    return -F.log((c + lit(1)) / lit(255))


#: Hematoxylin and eosin directions of the usual stain matrix.
STAIN = ((0.650, 0.072), (0.704, 0.990), (0.286, 0.105))


def stain_rows() -> list[list[float]]:
    """Pseudo-inverse of the column-normalised stain matrix."""
    import numpy as np

    m = np.array(STAIN)
    return np.linalg.pinv(m / np.linalg.norm(m, axis=0)).tolist()


def hematoxylin(rgb: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Concentration of the first stain per pixel, stretched to 0..255 and truncated."""
    h = sum((lit(k) * optical_density(F.col(c)) for k, c in zip(stain_rows()[0], "rgb", strict=True)), lit(0))
    return minmax_u8(rgb.withColumn("v", h), key).drop("r", "g", "b")


def percentile_limits(pixels: DataFrame, lo: float, hi: float, key: Sequence[str] = KEY) -> DataFrame:
    """Linear-interpolated percentiles, per image."""
    return pixels.groupBy(*key).agg(F.percentile("v", lo).alias("p_lo"), F.percentile("v", hi).alias("p_hi"))


def stretch(pixels: DataFrame, lo: float = 0.01, hi: float = 0.997, key: Sequence[str] = KEY) -> DataFrame:
    """Percentile stretch to 0..255, truncated; a flat range becomes 0."""
    span = F.nullif(F.col("p_hi") - F.col("p_lo"), lit(0))
    v = clamp((F.col("v") - F.col("p_lo")) / span, 0.0, 1.0) * lit(255)
    return pixels.join(percentile_limits(pixels, lo, hi, key), list(key)).withColumn("v", truncated(F.coalesce(v, lit(0)))).drop("p_lo", "p_hi")


def lut_index(pixels: DataFrame, threshold: int = 300, key: Sequence[str] = KEY) -> DataFrame:
    """Values below the threshold lifted to it, then stretched by minimum and maximum to 0..255."""
    return minmax_u8(pixels.withColumn("v", F.greatest("v", F.lit(threshold))), key)


def apply_lut(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    """Colours by table (i, r, g, b); a table has 256 rows, so it is broadcast."""
    return pixels.join(F.broadcast(lut), F.col("v") == F.col("i")).drop("i")


def inverted_lut(spark) -> DataFrame:
    """A grey table, dark for bright."""
    i = F.col("id").cast("int")
    return spark.range(256).select(i.alias("i"), (255 - i).alias("r"), (255 - i).alias("g"), (255 - i).alias("b"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 grey."""
    return lit(0.2125) * r + lit(0.7154) * g + lit(0.0721) * b


def grey_u8(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 grey, rounded."""
    return F.round(lit(0.299) * r + lit(0.587) * g + lit(0.114) * b).cast("int")


def any_channel_mask(rgb: DataFrame, threshold: int = 20) -> DataFrame:
    """255 where all channels are dark, 0 where one is above the threshold."""
    return rgb.withColumn("v", F.when(F.greatest("r", "g", "b") > threshold, 0).otherwise(255)).drop("r", "g", "b")


def blend(a: Column, b: Column, wa: float = 0.7, wb: float = 0.8) -> Column:
    """Weighted sum, rounded half to even and saturated at 255."""
    return F.least(F.lit(255), half_even(lit(wa) * a + lit(wb) * b).cast("int"))


def composite(bg: Column, fg: Column, alpha: Column) -> Column:
    return trunc_int(bg * (lit(1) - alpha) + fg * alpha)


def decimate(pixels: DataFrame, ds: int, h: int, w: int) -> DataFrame:
    """Nearest decimation: destination pixel d takes source floor(d * size / size_d)."""
    hd, wd = h // ds, w // ds
    dst = pixels.sparkSession.range(hd * wd).select(
        F.floor(F.col("id") / wd).cast("int").alias("yd"), (F.col("id") % wd).cast("int").alias("xd")
    )
    dst = dst.withColumns({"y": F.floor(F.col("yd") * F.lit(h) / hd).cast("int"), "x": F.floor(F.col("xd") * F.lit(w) / wd).cast("int")})
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    return pixels.join(dst, ["y", "x"]).select(*rest, F.col("yd").alias("y"), F.col("xd").alias("x"))


def upsample(pixels: DataFrame, k: int) -> DataFrame:
    """Nearest enlargement by a whole factor."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    rows = pixels.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return rows.select(*rest, (F.col("y") * k + F.col("_i")).alias("y"), (F.col("x") * k + F.col("_j")).alias("x"))


def neighbourhood(pixels: DataFrame, offsets: Sequence[tuple[int, int, float]], how: str, key: Sequence[str] = KEY) -> DataFrame:
    """Aggregate over a small window of offsets (dy, dx, weight); pixels outside the image don't count.

    ``how``: "min", "max" or "sum" (of weight * v). Each pixel is sent to the places that it
    contributes to, and partial sums combine before the shuffle.
    """
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), lit(w).alias("w")) for dy, dx, w in offsets])
    sent = pixels.withColumn("_o", F.explode(table)).select(
        *key, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x"),
        (F.col("v") * F.col("_o.w") if how == "sum" else F.col("v")).alias("v"),
        ((F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)).alias("own"),
    )
    agg = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    return sent.groupBy(*key, "y", "x").agg(agg("v").alias("v"), F.bool_or("own").alias("own")).where("own").drop("own")


def square(r: int) -> list[tuple[int, int, float]]:
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def disk(r: int) -> list[tuple[int, int, float]]:
    return [(dy, dx, 1.0) for dy, dx, _ in square(r) if dy * dy + dx * dx <= r * r]


#: The usual 3x3 sharpening kernel.
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))


def sharpen(pixels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    offsets = [(dy - 1, dx - 1, float(w)) for dy, row in enumerate(SHARPEN) for dx, w in enumerate(row) if w]
    return neighbourhood(pixels, offsets, "sum", key).withColumn("v", clamp(F.col("v"), 0.0, 255.0).cast("int"))


def erode(pixels: DataFrame, offsets, key: Sequence[str] = KEY) -> DataFrame:
    return neighbourhood(pixels, offsets, "min", key)


def dilate(pixels: DataFrame, offsets, key: Sequence[str] = KEY) -> DataFrame:
    return neighbourhood(pixels, offsets, "max", key)


def opening(pixels: DataFrame, offsets, key: Sequence[str] = KEY) -> DataFrame:
    return dilate(erode(pixels, offsets, key), offsets, key)


def closing(pixels: DataFrame, offsets, key: Sequence[str] = KEY) -> DataFrame:
    return erode(dilate(pixels, offsets, key), offsets, key)


def smooth(pixels: DataFrame, n: int = 2, key: Sequence[str] = KEY) -> DataFrame:
    """Opening, then closing, with a disk."""
    return closing(opening(pixels, disk(n), key), disk(n), key)


def boundary(labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Labelled pixels of which a 4-neighbour inside the image has another label."""
    cross = [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
    lo = neighbourhood(labels, cross, "min", key).withColumnRenamed("v", "lo")
    hi = neighbourhood(labels, cross, "max", key).withColumnRenamed("v", "hi")
    return labels.join(lo, [*key, "y", "x"]).join(hi, [*key, "y", "x"]).where("v > 0 and lo <> hi").drop("lo", "hi")


def otsu(pixels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Threshold of largest between-class variance over the 256-bin histogram; the least one on ties.

    A constant image gets its own value.
    """
    counts = pixels.groupBy(*key, "v").agg(F.count("*").alias("n"))
    run = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    n, nv = F.col("n"), F.col("n") * F.col("v")
    sums = counts.withColumns({"n0": F.sum(n).over(run), "s0": F.sum(nv).over(run), "nt": F.sum(n).over(whole), "st": F.sum(nv).over(whole)})
    n0, n1 = F.col("n0").cast("double"), (F.col("nt") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("st") - F.col("s0")) / F.nullif(n1, lit(0))
    score = F.coalesce(n0 * n1 * gap * gap, lit(0))
    best = sums.withColumn("score", half_even(score, 6)).groupBy(*key).agg(F.max(F.struct("score", (-F.col("v")).alias("m"))).alias("b"))
    return best.select(*key, (-F.col("b.m")).alias("threshold"))


def replicate_fit(w: Column, h: Column, box_w: int, box_h: int) -> Column:
    """Scale at which an image fits in a box."""
    return F.least(F.lit(float(box_w)) / w, F.lit(float(box_h)) / h)


def corner_mark(h: int, w: int, length: int) -> Column:
    """Where a watermark bar of the bottom right corner lies."""
    return (F.col("y") == h - 1) & (F.col("x") >= w - length)


def comparison_frames(a: DataFrame, b: DataFrame, mark: Column) -> DataFrame:
    """Two images as alternating frames, watermarked in white."""
    both = a.withColumn("frame", F.lit(0)).unionByName(b.withColumn("frame", F.lit(1)))
    return both.withColumn("v", F.when(mark, 255).otherwise(F.col("v")))
