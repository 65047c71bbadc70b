"""Overrides, anchors and selections: keyed joins, upserts, deletes, set operations, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_even, lit

OVERRIDE_KEY = ("tile_id", "nucleus_id", "kind")


def last_of_key(log: DataFrame, key: Sequence[str] = OVERRIDE_KEY, order: str = "seq") -> DataFrame:
    """Last write wins. A keyed aggregate: the newest row of a key combines before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return newest.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, fresh: DataFrame, key: Sequence[str] = OVERRIDE_KEY) -> DataFrame:
    """Rows of ``table`` whose key isn't in ``fresh``, and those of ``fresh``."""
    return table.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str] = OVERRIDE_KEY) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def split_by_key(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows removed)."""
    k = keys.select(*key).distinct()
    return table.join(k, list(key), "left_anti"), table.join(k, list(key), "left_semi")


def merge_objects(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Field-wise merge of two keyed tables; the newer value wins where there is one."""
    a = old.select(key, *[F.col(c).alias(f"_a_{c}") for c in values])
    b = new.select(key, *[F.col(c).alias(f"_b_{c}") for c in values])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in values])


def place_anchors(anchors: DataFrame, tiles: DataFrame, scale: float = 1.0, default_to_centre: bool = False) -> DataFrame:
    """Anchor places in the image: tile origin plus local place, scaled and rounded.

    Missing local places are the tile's centre if asked for. Tiles are the small side of the join.
    """
    x, y = F.col("x"), F.col("y")
    if default_to_centre:
        x, y = F.coalesce(x, F.col("w") / 2), F.coalesce(y, F.col("h") / 2)
    joined = anchors.join(tiles, "tile_id")
    return joined.withColumns({"gx": half_even((F.col("x0") + x) * lit(scale)).cast("long"), "gy": half_even((F.col("y0") + y) * lit(scale)).cast("long")})


def with_overrides(points: DataFrame, overrides: DataFrame, kinds: Sequence[str] = ("dapi", "he")) -> DataFrame:
    """Points with places per kind (dapi_x, ...) replaced by the last override, and a flag."""
    latest = last_of_key(overrides).select(*OVERRIDE_KEY, "x", "y")
    out = points
    flags: list[Column] = []
    for k in kinds:
        own = latest.where(F.col("kind") == k).select("tile_id", "nucleus_id", F.col("x").alias(f"_{k}_x"), F.col("y").alias(f"_{k}_y"))
        out = out.join(own, ["tile_id", "nucleus_id"], "left").withColumns({f"{k}_x": F.coalesce(f"_{k}_x", f"{k}_x"), f"{k}_y": F.coalesce(f"_{k}_y", f"{k}_y")})
        flags.append(F.col(f"_{k}_x").isNotNull())
    any_flag = flags[0]
    for f in flags[1:]:
        any_flag = any_flag | f
    return out.withColumn("overridden", any_flag).drop(*[f"_{k}_{c}" for k in kinds for c in "xy"])


def matched_keys(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a with a partner in b, keys of either side without one)."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return a.join(kb, key, "left_semi"), ka.join(kb, key, "left_anti").unionByName(kb.join(ka, key, "left_anti"))


def good_tiles(results: DataFrame, min_pairs: int = 1, threshold: float = 0.5) -> DataFrame:
    """Tiles with pairs enough and a score strictly above the threshold."""
    return results.where((F.col("n_pairs") >= min_pairs) & (F.col("score") > threshold))


def select_final(results: DataFrame, min_good: int, min_pairs: int = 1, threshold: float = 0.5, need: str = "raise") -> DataFrame:
    """Tiles to use and how: by pairs if enough are good, else by centre if enough score, else an error.

    The counts are scalar aggregates joined to every row; with ``need="empty"`` no error is raised.
    """
    ok = F.col("score") > threshold
    good = ok & (F.col("n_pairs") >= min_pairs)
    tally = results.agg(F.count_if(good).alias("_g"), F.count_if(ok).alias("_s"))
    failed = F.raise_error(F.lit("too few tiles align")) if need == "raise" else F.lit(None)
    mode = F.when(F.col("_g") >= min_good, "nuclei_pair").when(F.col("_s") >= min_good, "tile_center").otherwise(failed.cast("string"))
    out = results.crossJoin(F.broadcast(tally)).withColumn("mode", mode)
    return out.where(F.when(F.col("mode") == "nuclei_pair", good).when(F.col("mode") == "tile_center", ok).otherwise(False)).drop("_g", "_s")


def first_per_tile(rows: DataFrame, n: int, order: Sequence[Column | str], key: str = "tile_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def numbered(rows: DataFrame, order: Sequence[Column | str], key: str = "tile_id") -> DataFrame:
    """Ids from 0 within each tile."""
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def paired_by_rank(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """The i-th click of one side with the i-th of the other, as far as both go."""
    def ranked(side: DataFrame, n: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(key).orderBy(order))
        return side.select(key, r.alias("rank"), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))

    return ranked(a, "a").join(ranked(b, "b"), [key, "rank"])
