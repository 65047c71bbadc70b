"""Alignment search: scores of scales and shifts between mask pairs, argmax, median scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dice, lit

PAIR = ("pair_id",)


def search_grid(spark, scales: Sequence[float], tx: Sequence[int], ty: Sequence[int]) -> DataFrame:
    """Every scale with every shift, numbered in the order scale, tx, ty."""
    s, a, b = (F.array(*[F.lit(v) for v in c]) for c in (list(map(float, scales)), list(tx), list(ty)))
    return spark.range(1).select(F.explode(s).alias("scale")).select("scale", F.explode(a).alias("tx")).select("scale", "tx", F.explode(b).alias("ty"))


def warp_source(d: Column, size: int, s: Column | float, t: Column | float) -> Column:
    """Source place (nearest) of a destination place under a centred scale and a shift."""
    c = size // 2
    return F.floor((d - t - c) / s + c + lit(0.5))


def warp(mask: DataFrame, grid: DataFrame, h: int, w: int, key: Sequence[str] = PAIR) -> DataFrame:
    """The foreground of each mask under each (scale, tx, ty): destination pixels look up their source."""
    dst = mask.sparkSession.range(h * w).select(F.floor(F.col("id") / w).alias("yd"), (F.col("id") % w).alias("xd"))
    plan = grid.crossJoin(dst).select(
        "scale", "tx", "ty", "yd", "xd", warp_source(F.col("yd"), h, F.col("scale"), F.col("ty")).alias("y"), warp_source(F.col("xd"), w, F.col("scale"), F.col("tx")).alias("x")
    ).where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    fg = mask.where("fg = 1").select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return fg.join(plan, ["y", "x"]).select(*key, "scale", "tx", "ty", F.col("yd").alias("y"), F.col("xd").alias("x"))


def grid_scores(a: DataFrame, b: DataFrame, grid: DataFrame, h: int, w: int, key: Sequence[str] = PAIR, clip_first: bool = True) -> DataFrame:
    """Dice of mask a with mask b at every grid point.

    ``clip_first`` scales b, cuts it to the canvas, and shifts the cut mask, as the coarse and fine
    searches do; otherwise b is warped at once. Foreground pixels only, counted by grid point.
    """
    if clip_first:
        scales = grid.select("scale").distinct().withColumns({"tx": F.lit(0), "ty": F.lit(0)})
        scaled = warp(b, scales, h, w, key).drop("tx", "ty")
        moved = scaled.join(F.broadcast(grid), "scale").select(*key, "scale", "tx", "ty", (F.col("y") + F.col("ty")).alias("y"), (F.col("x") + F.col("tx")).alias("x"))
        moved = moved.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    else:
        moved = warp(b, grid, h, w, key)
    fa = a.where("fg = 1").select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(1).alias("in_a"))
    na = fa.groupBy(*key).agg(F.count("*").alias("na"))
    sums = moved.join(fa, [*key, "y", "x"], "left").groupBy(*key, "scale", "tx", "ty").agg(F.count("*").alias("nb"), F.count("in_a").alias("ab"))
    every = na.crossJoin(F.broadcast(grid)).join(sums, [*key, "scale", "tx", "ty"], "left")
    nb, ab = F.coalesce("nb", F.lit(0)), F.coalesce("ab", F.lit(0))
    return every.select(*key, "scale", "tx", "ty", dice(ab, F.col("na"), nb).alias("score"))


def best_alignment(scores: DataFrame, key: Sequence[str] = PAIR) -> DataFrame:
    """The grid point of the best score; the first in the order scale, tx, ty on ties."""
    top = F.struct(F.round("score", 9).alias("score"), (-F.col("scale")).alias("s"), (-F.col("tx")).alias("x"), (-F.col("ty")).alias("y"), F.col("score").alias("raw"))
    best = scores.groupBy(*key).agg(F.max(top).alias("b"))
    return best.select(*key, (-F.col("b.s")).alias("scale"), (-F.col("b.x")).alias("tx"), (-F.col("b.y")).alias("ty"), F.col("b.raw").alias("score"))


def median_scale(best: DataFrame, first_n: int, key: str = "pair_id", default: float = 1.0) -> DataFrame:
    """Median scale over the first tiles in order of name."""
    return best.orderBy(key).limit(first_n).agg(F.coalesce(F.median("scale"), lit(default)).alias("scale"))


def refine_grid(spark, scale: float, tx: int, ty: int, side: int, scale_range: float = 0.02, scale_step: float = 0.005, shift_range: float = 0.05, shift_step: float = 0.01) -> DataFrame:
    """The fine grid around a coarse result."""
    n = int(scale_range // scale_step)
    r, step = round(shift_range * side), max(1, round(shift_step * side))
    return search_grid(spark, [scale * (1 + i * scale_step) for i in range(-n, n + 1)], range(tx - r, tx + r + 1, step), range(ty - r, ty + r + 1, step))


def offset_counts(a: DataFrame, b: DataFrame, reach: int, key: Sequence[str] = PAIR) -> DataFrame:
    """How many foreground pixels coincide at each shift of b, from one join on the pair."""
    fa = a.where("fg = 1").select(*key, F.col("y").alias("ay"), F.col("x").alias("ax"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    fb = b.where("fg = 1").select(*key, "y", "x").withColumn("ty", F.explode(steps)).withColumn("tx", F.explode(steps))
    moved = fb.select(*key, "tx", "ty", (F.col("y") + F.col("ty")).alias("ay"), (F.col("x") + F.col("tx")).alias("ax"))
    return fa.join(moved, [*key, "ay", "ax"]).groupBy(*key, "tx", "ty").agg(F.count("*").alias("n"))
