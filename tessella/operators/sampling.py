"""Point sampling: grids, farthest points, Poisson disks, Lloyd steps, repair of close pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lit
from ..lineage import written
from .masks import close_counts, close_pairs, finite


#: Points that the driver picks from at once; chosen points of a round that are broadcast, at most.
FEW = 2000
#: Points of a block whose pairs with those of another a task measures.
BLOCK = 8192


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Numbers rows from 0 in order: each range of the order counts its own rows, from where the ranges before it end."""
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    parts = written(df.withColumns(keys).repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", first.alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    return parts.join(F.broadcast(before), "_p").withColumn(name, own + F.col("_before")).drop("_p", "_before", *keys)


def valid_coords(mask: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Available pixels; with a cap, that many of them by hash order, the same each time."""
    free = mask.where("fg = 1").select("y", "x")
    return free if cap is None else free.orderBy(F.xxhash64("y", "x", F.lit(seed)), "y", "x").limit(cap)


def grid_cells(points: DataFrame, bins: int = 6) -> DataFrame:
    """Grid cell (gx, gy) of each point within the points' extent."""
    e = points.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))

    def bin_of(c, lo, hi):
        span = F.greatest(F.col(hi) - F.col(lo), lit(1e-9))
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(lo)) / span * bins)).cast("int")

    return points.crossJoin(F.broadcast(e)).withColumns({"gx": bin_of("x", "_x0", "_x1"), "gy": bin_of("y", "_y0", "_y1")}).drop("_x0", "_x1", "_y0", "_y1")


def grid_balanced(points: DataFrame, per_cell: int = 4, bins: int = 6, prefer: str = "score", seed: int = 0) -> DataFrame:
    """At most ``per_cell`` points of each grid cell: the best by ``score``, by hash ("random"), or spread out."""
    cells = grid_cells(points, bins)
    if prefer == "spread":
        ddl = cells.schema

        def spread(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pid", kind="stable").reset_index(drop=True)
            return pdf.iloc[farthest(pdf[["x", "y"]].to_numpy(dtype=float), per_cell, 0)]

        return cells.groupBy("gx", "gy").applyInPandas(spread, ddl)
    order = [F.desc("score"), "pid"] if prefer == "score" else [F.xxhash64("pid", F.lit(seed)), "pid"]
    rank = F.row_number().over(Window.partitionBy("gx", "gy").orderBy(*order))
    return cells.withColumn("rank", rank).where(F.col("rank") <= per_cell).drop("rank")


def farthest(xy: np.ndarray, k: int, first: int) -> list[int]:
    """Greedy farthest points from a start; the first of equally far ones."""
    chosen = [first]
    d = ((xy - xy[first]) ** 2).sum(1)
    while len(chosen) < min(k, len(xy)):
        i = int(d.argmax())
        chosen.append(i)
        d = np.minimum(d, ((xy - xy[i]) ** 2).sum(1))
    return chosen


def farthest_points(points: DataFrame, k: int) -> DataFrame:
    """k farthest points, from the one nearest to the mean. One pass over the points for each.

    Only the chosen points (k of them) are held by the driver.
    """
    m = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    chosen: list[tuple] = []
    near = (F.col("x") - lit(m.x)) ** 2 + (F.col("y") - lit(m.y)) ** 2
    start = points.select("pid", "x", "y", near.alias("d")).orderBy(F.round("d", 6), "pid").first()
    chosen.append((0, start.pid, float(start.x), float(start.y)))
    for i in range(1, k):
        gaps = [(F.col("x") - lit(x)) ** 2 + (F.col("y") - lit(y)) ** 2 for _, _, x, y in chosen]
        d = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        far = points.select("pid", "x", "y", d.alias("d")).orderBy(F.desc(F.round("d", 6)), "pid").first()
        if far is None or far.d <= 0:
            break
        chosen.append((i, far.pid, float(far.x), float(far.y)))
    return points.sparkSession.createDataFrame(chosen, "step int, pid long, x double, y double")


def _first_apart(own: DataFrame, min_dist: float, n: int) -> DataFrame:
    """The first ``n`` points of the greedy set: batches in order of rank, each without what is too near to points chosen before.

    The driver holds a batch and the points chosen. Each batch adds its first point at least.
    """
    chosen: list[tuple] = []
    order = ["rank", "pid", "x", "y"]
    rows = own.select(*order)
    rest = rows
    while True:
        batch = rest.orderBy(*order).limit(FEW).collect()
        for p in batch:
            placed = p.x is not None and p.y is not None and np.isfinite(p.x) and np.isfinite(p.y)
            if len(chosen) < n and not (placed and any((p.x - x) ** 2 + (p.y - y) ** 2 < min_dist * min_dist for _, _, x, y in chosen if x is not None and y is not None)):
                chosen.append(tuple(p))
        got = own.sparkSession.createDataFrame(chosen, rows.schema)
        if len(batch) < FEW or len(chosen) >= n:
            break
        at = got.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        near = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 < min_dist * min_dist
        last = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, batch[-1], strict=True)])
        rest = rows.where(F.struct(*order) > last).join(F.broadcast(at), near, "left_anti")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("pid", "x", "y")]
    return own.alias("o").join(F.broadcast(got.alias("g")), same, "left_semi").orderBy(*order).limit(n).drop("rank")


def poisson_disk(points: DataFrame, min_dist: float, n: int | None = None, seed: int = 0) -> DataFrame:
    """A maximal set of points at least ``min_dist`` apart, greedy in hash order; of a few, ``n``, the first ones.

    Points of a cell of 0.7 ``min_dist`` are too near to each other, so that only the first of each can be next. It enters
    if it comes before the first ones of all cells around, and what is too near to it goes; rounds go on until
    no point is undecided, so the result doesn't depend on partitions, and no pairs of points are formed.
    Points without coordinates are near to none.
    """
    own = points.withColumn("rank", F.xxhash64("pid", F.lit(seed)))
    if n is not None and n <= FEW:
        return _first_apart(own, min_dist, n)
    own = written(own)
    at = ["_gx", "_gy"]
    cell = {c: F.floor(F.col(v) / lit(0.7 * min_dist)) for c, v in zip(at, "xy", strict=True)}
    left = written(finite(own).select("rank", "pid", "x", "y").withColumns(cell))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)])

    def around(df: DataFrame, *cols) -> DataFrame:
        """Each row in its cell and the 24 around."""
        sent = df.withColumn("_o", F.explode(steps))
        return sent.select((F.col("_gx") + F.col("_o.dx")).alias("_gx"), (F.col("_gy") + F.col("_o.dy")).alias("_gy"), *cols)

    inside = []
    for _ in range(200):
        low = written(left.groupBy(*at).agg(F.min(F.struct("rank", "pid", "x", "y")).alias("m")))
        least = around(low, "m").groupBy(*at).agg(F.min("m").alias("least"))
        chosen = written(low.join(least.hint("merge"), at).where(F.col("m") == F.col("least")).select(*at, "m"))
        if not (count := chosen.count()):
            break
        inside.append(chosen.select("m.pid", "m.x", "m.y"))
        sent = around(chosen, F.col("m.x").alias("_x"), F.col("m.y").alias("_y"))
        sent = F.broadcast(sent) if count <= FEW else sent.hint("merge")
        near = (F.col("l.x") - F.col("s._x")) ** 2 + (F.col("l.y") - F.col("s._y")) ** 2 < min_dist * min_dist
        left = written(left.alias("l").join(sent.alias("s"), [F.col(f"l.{c}") == F.col(f"s.{c}") for c in at] + [near], "left_anti"))
    else:
        raise RuntimeError("points are still undecided after 200 rounds")
    plain = F.coalesce(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") != float("inf")) & (F.abs("y") != float("inf")), F.lit(False))
    kept = own.where(~plain)
    if inside:
        kept = kept.unionByName(own.join(reduce(DataFrame.unionByName, inside), ["pid", "x", "y"], "left_semi"))
    kept = kept.select(*own.columns)
    return kept.orderBy("rank", "pid").limit(n).drop("rank") if n is not None else kept.drop("rank")


def _owned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with their nearest centre, without a shuffle: the centres are one row that all tasks get."""
    all_of = centres.agg(F.collect_list(F.struct("cid", "cx", "cy")).alias("_cs"))
    gap = F.transform("_cs", lambda c: F.struct(((F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2).alias("d2"), c["cid"].alias("cid")))
    met = points.crossJoin(F.broadcast(all_of)).withColumn("m", F.array_min(gap)).where("m is not null")
    return met.select("pid", "x", "y", F.col("m.cid").alias("cid"), F.col("m.d2").alias("d2"))


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Each point's nearest centre (cid, cx, cy); ties go to the lower id. The centres are few and broadcast."""
    return _owned(points.select("pid", "x", "y").distinct(), centres)


def _owned_by(points: DataFrame, rows: list[tuple]) -> DataFrame:
    """Points with the nearest of centres that the driver holds, in order of their ids."""
    cid, cx, cy = (np.array(c) for c in zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in "xy")
            step = max(1, (1 << 18) // len(cid))
            best = [np.argmin((x[i : i + step] - cx) ** 2 + (y[i : i + step] - cy) ** 2, axis=1) for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid[np.concatenate(best)] if best else cid[:0])], names=["pid", "x", "y", "cid"])

    return points.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", cid long")


def _moved(owned: DataFrame, centres: DataFrame) -> DataFrame:
    mean = owned.groupBy("cid").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    gap = F.round((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2, 6)
    snapped = owned.join(F.broadcast(mean), "cid").groupBy("cid").agg(F.min(F.struct(gap.alias("g"), F.col("pid"), F.col("x"), F.col("y"))).alias("m"))
    return centres.join(snapped, "cid", "left").select("cid", F.coalesce("m.x", "cx").alias("cx"), F.coalesce("m.y", "cy").alias("cy"))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres moved to the member nearest to their cell's mean; a centre without members stays."""
    return _moved(nearest_centre(points, centres), centres)


def lloyd(points: DataFrame, centres: DataFrame, iterations: int = 50) -> DataFrame:
    """Repeated steps until no centre moves. The centres, a fixed small number, go through the driver."""
    spark = points.sparkSession
    points = written(points.select("pid", "x", "y").distinct())
    rows = sorted(tuple(r) for r in centres.select("cid", "cx", "cy").collect())
    for _ in range(iterations if rows else 0):
        now = spark.createDataFrame(rows, "cid long, cx double, cy double")
        moved = sorted(tuple(r) for r in _moved(_owned_by(points, rows), now).select("cid", F.col("cx").cast("double"), F.col("cy").cast("double")).collect())
        if moved == rows:
            break
        rows = moved
    return spark.createDataFrame(rows, "cid long, cx double, cy double")


def crowding(points: DataFrame, r: float, key: Sequence[str] = ()) -> DataFrame:
    """Points with neighbours at most r away, and how many, worst first."""
    return close_counts(points, r, key).groupBy("pid").agg(F.sum("bad").alias("bad")).orderBy(F.desc("bad"), "pid")


def repel(points: DataFrame, coords: DataFrame, min_sep: float, rounds: int = 20, seed: int = 0) -> DataFrame:
    """Move points that are too close to others to free coordinates, a round at a time.

    In each round every point that is the later one of a close pair takes the coordinate of its turn in hash order.
    After ``rounds`` rounds the points stay where they are, as a crowded image may have no room for all.
    """
    n = coords.count()
    if not n:
        return points
    spots = numbered(coords.select("x", "y"), [F.xxhash64("y", "x", F.lit(seed)), F.col("y"), F.col("x")], "spot")
    spots = written(spots.select(F.col("x").cast("double").alias("nx"), F.col("y").cast("double").alias("ny"), "spot"))
    now = points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for i in range(rounds):
        late = written(close_pairs(now, min_sep).select(F.col("j").alias("pid")).distinct())
        if not late.limit(1).count():
            break
        moved = late.withColumn("spot", F.pmod(F.xxhash64("pid", F.lit(seed + i)), F.lit(n))).join(spots, "spot")
        now = now.join(moved.select("pid", "nx", "ny"), "pid", "left").select("pid", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))
        now = written(now)
    return now


def dispersion(points: DataFrame) -> DataFrame:
    """Mean, population deviation and maximum of the pairwise distances, and how many pairs ``n`` there are.

    Points are dealt to blocks by their id, and each pair of blocks is measured in one task. Pairs are of different ids;
    those without a distance, as a coordinate is null, count in ``n`` only.
    """
    p = points.where("pid is not null").select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = written(p)
    blocks = max(1, -(-p.count() // BLOCK))
    dealt = p.withColumn("_b", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = dealt.select(F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), (F.col("_b") <= F.col("_o")).alias("_left"), "pid", "x", "y")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py() == key[1].as_py()
        gone = pc.or_(table.column("x").is_null(), table.column("y").is_null()).to_numpy()
        x, y = (table.column(c).to_numpy() for c in "xy")
        pid = table.column("pid").combine_chunks().dictionary_encode().indices.to_numpy()
        left = table.column("_left").to_numpy()
        order = np.argsort(pid, kind="stable")
        a, b = (order, order) if own else (np.flatnonzero(left), np.flatnonzero(~left))
        n = met = 0
        mean = m2 = far = 0.0
        for start in range(0, len(a), 64):
            i, j = a[start : start + 64], b[start:] if own else b
            pair = pid[i][:, None] < pid[j] if own else np.ones((len(i), len(j)), dtype=bool)
            n += int(pair.sum())
            d = np.hypot(x[i][:, None] - x[j], y[i][:, None] - y[j])[pair & ~gone[i][:, None] & ~gone[j]]
            if len(d):
                gap, total = d.mean() - mean, met + len(d)
                m2 += ((d - d.mean()) ** 2).sum() + gap * gap * met * len(d) / total
                mean, met, far = mean + gap * len(d) / total, total, max(far, d.max())
        return pa.table({"n": [n], "met": [met], "mean": [float(mean)], "m2": [float(m2)], "far": [float(far)]})

    found = written(rows.groupBy("_p", "_q").applyInArrow(run, "n long, met long, mean double, m2 double, far double"))
    some = found.where("met > 0")
    total = some.agg(F.sum("met").alias("met"), (F.sum(F.col("met") * F.col("mean")) / F.sum("met")).alias("whole"), F.max("far").alias("far"))
    within = some.crossJoin(F.broadcast(total.select("whole"))).agg(F.sum(F.col("m2") + F.col("met") * (F.col("mean") - F.col("whole")) ** 2).alias("m2"))
    count = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return count.crossJoin(total).crossJoin(within).select("n", F.col("whole").alias("mean"), F.sqrt(F.col("m2") / F.col("met")).alias("sd"), "far")


def in_view(points: DataFrame, w: float, h: float, cap: int) -> DataFrame:
    """Points inside an image; of more than ``cap``, every k-th in order of id."""
    inside = points.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    step = max(1, -(-inside.count() // cap))
    if step == 1:
        return inside
    return numbered(inside, [F.col("pid")], "_r").where(F.col("_r") % step == 0).drop("_r")
