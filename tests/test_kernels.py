"""Array kernels, image files, fits and coordinate maps against plain NumPy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import fitting, masks, raster, sampling
from tessella.sources import artefacts, images


def brute_labels(fg, near):
    lab = np.zeros(fg.shape, int)
    n = 0
    for y, x in np.argwhere(fg):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < fg.shape[0] and 0 <= b < fg.shape[1] and fg[a, b] and not lab[a, b]:
                lab[a, b] = n
                todo += [(a + dy, b + dx) for dy, dx in near]
    return lab


CROSS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
AROUND = CROSS + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


@pytest.mark.parametrize(("connectivity", "near"), [(4, CROSS), (8, AROUND)])
def test_labels(connectivity, near):
    rng = np.random.default_rng(3)
    for _ in range(40):
        fg = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.5
        assert (masks.label_image(fg, connectivity) == brute_labels(fg, near)).all()


def test_distance():
    fg = np.random.default_rng(1).random((9, 13)) < 0.8
    want = np.array([[min((np.hypot(y - a, x - b) for a, b in np.argwhere(~fg)), default=99) if fg[y, x] else 0 for x in range(13)] for y in range(9)])
    assert np.allclose(masks.chamfer(fg), want)


def test_holes():
    fg = np.ones((9, 9), bool)
    fg[4, 4] = fg[0, 2] = False
    done = masks.fill_holes_image(fg)
    assert done[4, 4] and not done[0, 2]


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("bands", [1, 3])
def test_image_files(dtype, bands):
    a = np.random.default_rng(0).integers(0, np.iinfo(dtype).max, (7, 5, bands)).astype(dtype)
    assert (images.read_png(images.write_png(a)) == a).all()
    for deflate in (True, False):
        data = images.write_tiff([a, a[::2, ::2], a[::4, ::4]], deflate)
        for k, level in enumerate((a, a[::2, ::2], a[::4, ::4])):
            assert (images.read_tiff(data, k) == level).all()
    if dtype == np.uint8:
        head = b"P6" if bands == 3 else b"P5"
        assert (images.read_pnm(head + b"\n# note\n5 7\n255\n" + a.tobytes()) == a).all()


def test_image_source(spark, tmp_path):
    a = np.arange(60, dtype=np.uint8).reshape(6, 10)
    (tmp_path / "a.png").write_bytes(images.write_png(a))
    rows = images.read_images(spark, str(tmp_path), "*.png")
    assert rows.agg(F.sum("v")).first()[0] == a.sum()
    spark.dataSource.register(images.ImageSource)
    again = spark.read.format("tissue_image").option("path", str(tmp_path / "a.png")).option("rows", "2").load()
    assert again.rdd.getNumPartitions() == 3 and again.agg(F.sum("v")).first()[0] == a.sum()


def test_orientation_round_trip():
    for case in range(8):
        a = np.arange(15).reshape(3, 5)
        want = [a, np.rot90(a, 3), np.rot90(a, 2), np.rot90(a), np.flipud(a), np.fliplr(a), a.T, np.flipud(np.fliplr(a)).T][case]
        got = np.full(want.shape, -1)
        for y in range(3):
            for x in range(5):
                u, v = C.orient(case, x, y, 5, 3)
                got[v, u] = a[y, x]
        assert (got == want).all(), case


def test_guards(spark):
    m = [[1, 0, 0], [0, 1, 0], [0, 0.125, 1]]
    row = spark.range(1).select(*[F.concat_ws(",", *C.homography_xy(m, F.lit(0.0), F.lit(-8.0), g)).alias(g) for g in C.GUARDS]).first()
    assert len({row[g] for g in C.GUARDS}) == 3


def test_otsu_separates(spark):
    rows = [(1, i, 20 if i < 80 else 200) for i in range(144)] + [(2, i, 7) for i in range(9)]
    df = spark.createDataFrame(rows, "tile_id int, x int, v int").withColumn("y", F.lit(0))
    got = {r.tile_id: r.threshold for r in raster.otsu(df).collect()}
    assert 20 <= got[1] < 200 and got[2] == 7


def test_level_fallback(spark):
    df = spark.createDataFrame([(1, i, s, s) for i, s in enumerate((8000, 4000, 1500, 700))] + [(2, i, s, s) for i, s in enumerate((8000, 4000, 900))], "image int, level int, h int, w int")
    assert {r.image: r.level for r in raster.pick_level(df).collect()} == {1: 2, 2: 0}


def test_dice(spark):
    row = spark.range(1).select(C.dice(F.lit(8), F.lit(10), F.lit(12)).alias("d"), C.iou(F.lit(8), F.lit(10), F.lit(12)).alias("i")).first()
    assert abs(row.d - 16 / (22 + 1e-6)) < 1e-12 and abs(row.i - 8 / (14 + 1e-6)) < 1e-12


def test_ransac_recovers(spark):
    rng = np.random.default_rng(5)
    s = rng.random((300, 2)) * 1000
    m = np.array([[1.1, 0.05, 20], [-0.02, 0.95, -7]])
    d = np.c_[s, np.ones(300)] @ m.T + rng.normal(0, 0.5, (300, 2))
    d[::4] += 300
    df = spark.createDataFrame([(i, *map(float, (*s[i], *d[i]))) for i in range(300)], "pid long, sx double, sy double, dx double, dy double")
    got, scored = fitting.ransac(df, "affine")
    assert np.allclose(got, m, atol=1.0) and np.allclose(np.array(got)[:, :2], m[:, :2], atol=2e-3)
    assert scored.where("inlier").count() == 225
    h, _ = fitting.ransac(df, "homography")
    assert np.allclose(np.array(h)[:2, :2], m[:, :2], atol=2e-2)
    with pytest.raises(ValueError, match="needs"):
        fitting.ransac(df.limit(2), "affine")


def test_spline_interpolates(spark):
    s = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [4, 6]], float)
    d = s * 1.1 + 3
    model = fitting.spline_fit(s, d, 0.0)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in s], "x double, y double")
    got = [tuple(r) for r in df.select(*fitting.spline_xy(model, F.col("x"), F.col("y"))).collect()]
    assert np.allclose(got, d, atol=1e-6)


def test_poisson_disk_is_maximal(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((200, 2)) * 100
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")
    kept = {r.pid for r in sampling.poisson_disk(df, 12).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    for i in range(200):
        near = [j for j in kept if j != i and d[i, j] < 12]
        assert bool(near) != (i in kept)


@pytest.mark.parametrize("block", [sampling.BLOCK, 50])
def test_dispersion_of_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", block)
    r = np.random.default_rng(9)
    pts = [(i - i % 90 // 89, float(x), float(y)) for i, (x, y) in enumerate(1e5 + r.random((400, 2)) * 9)] + [(None, 0.0, 0.0), (1000, None, 0.0)]
    d = [np.hypot(a - c, b - e) for p, a, b in pts[:400] for q, c, e in pts[:400] if p < q]
    got = sampling.dispersion(spark.createDataFrame(pts, "pid long, x double, y double")).first()
    assert got.n == len(d) + 400
    assert np.allclose([got["mean"], got.sd, got.far], [np.mean(d), np.std(d), max(d)], rtol=1e-9)


def test_dispersion_of_more_than_a_driver_holds(spark):
    line = spark.range(20_001).selectExpr("id as pid", "double(id) as x", "0d as y")
    n = 20_001
    got = sampling.dispersion(line).first()
    assert got.n == n * (n - 1) // 2 and got.far == n - 1
    assert np.allclose([got["mean"], got.sd], [(n + 1) / 3, np.sqrt((n + 1) * (n - 2) / 18)])
    none = sampling.dispersion(line.where("pid = 0")).first()
    assert tuple(none) == (0, None, None, None)


def test_pair_distances_of_many_suppliers(spark, tmp_path):
    from tessella.plans.queries import QUERIES

    spark.range(20_001).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    assert QUERIES["jn13_pair_distances"](spark, str(tmp_path)).first().n == 20_001 * 20_000 // 2


def asked(con, name, table, path):
    """Rows of the query's SQL over a table of its own."""
    from tessella.plans.queries import ORACLES

    with con.cursor() as own:
        own.sql(f"CREATE TEMP VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
        return sorted(own.sql(ORACLES[name]).fetchall())


def test_pair_distances_equal_sql_beyond_a_block(spark, tmp_path, duck):
    from tessella.plans.queries import QUERIES

    keys = spark.range(20_500).selectExpr("nullif(id - id % 50 div 49, 7) as s_suppkey")  # with repeated keys and a null
    keys.write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES["jn13_pair_distances"](spark, str(tmp_path)).collect()
    (n, mean, far), = asked(duck, "jn13_pair_distances", "supplier", tmp_path)
    assert len(got) == 1 and got[0].n == n > 200_000_000
    assert np.allclose([got[0]["mean"], got[0].far], [mean, far], rtol=1e-9)


def crowd(seed=4):
    """Points with repeated ids and places, some without coordinates, in a dense and a sparse part."""
    r = np.random.default_rng(seed)
    xy = np.concatenate([r.integers(0, 60, (500, 2)) / 2, r.random((200, 2)) * 400 - 100, [[1e6, 5], [1e6 + 3, 9], [-7e5, 0]]])
    pts = [(i - i % 50 // 49, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    odd = [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("inf")), (None, 1.0, 1.0)]
    near = [(p, q, (a - c) ** 2 + (b - d) ** 2) for p, a, b in pts for q, c, d in pts if p < q and (a - c) ** 2 + (b - d) ** 2 <= 25]
    return pts + odd, near


@pytest.mark.parametrize(("own", "tile"), [(masks.OWN, masks.TILE), (40, 60)])
def test_crowding_counts_without_pairs(spark, own, tile, monkeypatch):
    monkeypatch.setattr(masks, "OWN", own)
    monkeypatch.setattr(masks, "TILE", tile)
    pts, near = crowd()
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    want = Counter(p for i, j, _ in near for p in (i, j))
    got = sampling.crowding(df, 5)
    assert [tuple(r) for r in got.collect()] == sorted(want.items(), key=lambda p: (-p[1], p[0]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "d2" not in plan
    assert sampling.crowding(df.where("false"), 5).collect() == []


def test_crowding_by_key(spark):
    rows = [(k, 10 * k + i, float(i), 0.0) for k in range(2) for i in range(4)]
    df = spark.createDataFrame(rows, "tile_id long, pid long, x double, y double")
    assert [tuple(r) for r in sampling.crowding(df, 1, ["tile_id"]).collect()] == [(1, 2), (2, 2), (11, 2), (12, 2), (0, 1), (3, 1), (10, 1), (13, 1)]


def test_worst_first_forms_no_pairs(spark, data):
    from tessella.plans.queries import QUERIES

    assert "d2" not in QUERIES["so03_worst_first"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_worst_first_of_crowded_parts(spark, tmp_path, duck):
    from tessella.plans.queries import QUERIES

    crowded = spark.range(3000).selectExpr(  # with repeated keys, and nulls
        "nullif(id - id % 50 div 49, 7) as p_partkey", "nullif(300.0d + id % 17 / 4, 302.0d) as p_retailprice", "nullif(int(id % 5), 3) as p_size", "'Brand#11' as p_brand"
    )
    crowded.write.parquet(str(tmp_path / "part.parquet"))
    df = QUERIES["so03_worst_first"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == asked(duck, "so03_worst_first", "part", tmp_path)
    assert "p_partkey" not in df._jdf.queryExecution().optimizedPlan().toString()  # parts aren't joined with parts, but written and counted


def test_repair_compares_the_lowest_of_cells(spark):
    pts, near = crowd()
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    got = masks.close_to_lower(df, 5)
    assert sorted(r.pid for r in got.collect()) == sorted({j for _, j, _ in near})


def test_close_pairs_broadcast_nothing(spark):
    pts, near = crowd()
    pairs = masks.close_pairs(spark.createDataFrame(pts, "pid long, x double, y double"), 5)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(near)
    pairs = masks.close_pairs(spark.range(50).selectExpr("id as pid", "double(id) as x", "0d as y"), 5)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_fast_rounding_is_rounding(spark):
    from tessella.plans.registry import rounded

    rng = np.random.default_rng(5)
    ties = (rng.integers(-(10**8), 10**8, 3000) + 0.5) / 1e6
    some = [*ties, *np.nextafter(ties, 0), *np.nextafter(ties, np.inf), *(rng.random(3000) * 1600), *(10.0 ** rng.uniform(-12, 300, 3000))]
    some = [*map(float, some), 0.0, -0.0, -1e-9, 999999.9999995, 1e6, -1e6, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in some], "v double").select((rounded(F.col("v")) + 0.0).alias("a"), (F.round("v", 6) + 0.0).alias("b"))
    assert df.where("not (a <=> b) or string(a) <> string(b)").collect() == []


def test_close_pairs_of_crowded_parts(spark, tmp_path, duck):
    from tessella.plans.queries import QUERIES

    crowded = spark.range(1500).selectExpr(  # with repeated keys, and nulls
        "nullif(id - id % 50 div 49, 7) as p_partkey", "nullif(300.0d + id % 17 / 7, 302.0d) as p_retailprice", "nullif(int(id % 5), 3) as p_size", "'Brand#11' as p_brand"
    )
    crowded.write.parquet(str(tmp_path / "part.parquet"))
    df = QUERIES["jn09_close_pairs"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == asked(duck, "jn09_close_pairs", "part", tmp_path)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.splitlines()[0] and "rint" in plan.lower()  # no decimal is made for each pair


@pytest.mark.parametrize("few", [sampling.FEW, 8])
def test_poisson_disk_is_greedy_in_hash_order(spark, few, monkeypatch):
    monkeypatch.setattr(sampling, "FEW", few)
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((500, 2)) * 30, rng.random((80, 2)) * 200 - 90, rng.integers(0, 40, (60, 2))]))]
    pts += [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    ranked = [(r.pid, r.x, r.y) for r in df.orderBy(F.xxhash64("pid", F.lit(0)), "pid").collect()]
    want = []
    for p, x, y in ranked:
        if not any(x is not None and c is not None and (x - c) ** 2 + (y - d) ** 2 < 25 for _, c, d in want):
            want.append((p, x, y))
    ids = [p for p, _, _ in want]
    assert sorted(r.pid for r in sampling.poisson_disk(df, 5).collect()) == sorted(ids)
    for n in (1, 7, 30, 3000):
        assert sorted(r.pid for r in sampling.poisson_disk(df, 5, n=n).collect()) == sorted(ids[:n])
    assert sampling.poisson_disk(df.where("false"), 5).collect() == []


def test_nearest_centres_need_one_shuffle(spark):
    pts = spark.range(40).selectExpr("id as pid", "double(id % 7) as x", "double(id % 5) as y")
    centres = spark.createDataFrame([(2, 0.0, 0.0), (1, 6.0, 4.0), (3, 6.0, 4.0)], "cid long, cx double, cy double")
    got = sampling.nearest_centre(pts, centres)
    want = {r.pid: min(((r.x - a) ** 2 + (r.y - b) ** 2, c) for c, a, b in ((2, 0, 0), (1, 6, 4), (3, 6, 4))) for r in pts.collect()}
    assert {r.pid: (r.d2, r.cid) for r in got.collect()} == want
    assert sampling.nearest_centre(pts, centres.where("false")).collect() == []


def test_lloyd_repeats_steps(spark):
    r = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(r.integers(0, 30, (300, 2)))], "pid long, x int, y int")
    now = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(6)], "cid long, cx double, cy double")
    want = now
    for _ in range(2):
        want = spark.createDataFrame(sampling.lloyd_step(pts, want).selectExpr("cid", "double(cx) as cx", "double(cy) as cy").collect(), now.schema)
    assert sorted(map(tuple, sampling.lloyd(pts, now, 2).collect())) == sorted(map(tuple, want.collect()))
    assert sampling.lloyd(pts, now.where("false"), 2).collect() == []


def test_balanced_grid_keeps_four(spark):
    df = spark.range(100).select(F.col("id").alias("pid"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.col("id").alias("score"))
    assert {r.pid for r in sampling.grid_balanced(df).collect()} == {96, 97, 98, 99}


def test_required_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cell_id,x_centroid\na,1\n")
    with pytest.raises(ValueError, match="y_centroid"):
        artefacts.read_cells(spark, str(tmp_path / "c.csv"))


def test_transform_kinds():
    assert fitting.transform_kind({"transform_type": "local_tps"}) == "tps"
    assert fitting.transform_kind({"matrix": [[1, 0, 0], [0, 1, 0]]}) == "affine"
    with pytest.raises(ValueError, match="unknown"):
        fitting.transform_kind({"transform_type": "x"})


def test_override_lines(spark):
    good = '{"tile_id":"a","nucleus_id":1,"image_kind":"he","manual_centroid_xy":[%d,2],"time":"t"}'
    lines = [(1, good % 5), (2, ""), (3, "{bad"), (4, good % 9), (5, '{"tile_id":"a","nucleus_id":1,"image_kind":"he","manual_centroid_xy":[1]}')]
    got = artefacts.parsed_overrides(spark.createDataFrame(lines, "seq int, line string"))
    assert sorted(r.seq for r in got.collect()) == [1, 4]


def test_versions(spark, tmp_path):
    df = spark.range(3)
    artefacts.snapshot(df, str(tmp_path / "v"), 0)
    artefacts.snapshot(spark.range(9), str(tmp_path / "v"), 0)
    assert artefacts.restore(spark, str(tmp_path / "v")).count() == 3


def test_distance_of_wide_images_needs_little_memory():
    import tracemalloc

    fg = np.ones((1000, 1000), bool)
    fg[::37, ::41] = False
    tracemalloc.start()
    d = masks.chamfer(fg)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert d[18, 20] == pytest.approx(np.hypot(18, 20)) and d[0, 0] == 0


def test_runs_of_wide_images(spark):
    mask = spark.createDataFrame([(0, 0, 1100, 1), (0, 1, 0, 1), (0, 1, 1, 1), (0, 2, 1199, 1)], "tile_id long, y int, x int, fg int")
    stats = masks.component_stats(masks.row_runs(mask, 1200))
    assert sorted((r.label, r.area) for r in stats.collect()) == [(1101, 1), (1201, 2), (3600, 1)]


def test_clusters_raise_where_rounds_are_too_few(spark):
    chain = spark.createDataFrame([(0, i, float(i * 7919 % 64), 0.0, 1) for i in range(64)], "tile_id long, label long, cx double, cy double, area long")
    with pytest.raises(RuntimeError):
        masks.clusters(chain, 1.0, rounds=1)
    assert {r.cluster for r in masks.clusters(chain, 1.0).collect()} == {0}


def test_numbering_over_ranges(spark):
    df = spark.range(500).selectExpr("id", "(id * 7919) % 1009 as k").repartition(7)
    got = {r.k: r.n for r in sampling.numbered(df, [F.col("k")], "n").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(got) and sorted(got.values()) == list(range(500))


def plain_stains(rgb):
    """The three images, from the equations, a pixel at a time where that is possible."""
    od = np.array([[-np.log((float(v) + 1) / 240) for v in p] for p in rgb.reshape(-1, 3)])
    solid = np.array([p for p in od if min(p) >= 0.15])
    _, vectors = np.linalg.eigh(np.cov(solid, rowvar=False))
    big, small = vectors[:, 2], vectors[:, 1]
    phi = [np.arctan2(p @ big, p @ small) for p in solid]
    ends = [small * np.cos(t) + big * np.sin(t) for t in (np.percentile(phi, 1), np.percentile(phi, 99))]
    he = np.array(sorted(ends, key=lambda v: -v[0])).T
    c = np.array([np.linalg.solve(he.T @ he, he.T @ p) for p in od])
    c = c / (np.percentile(c, 99, axis=0) / np.array([1.9705, 1.0308]))
    ref = np.array([[0.5626, 0.2159], [0.7201, 0.8012], [0.4062, 0.5581]])

    def light(v):
        v = 240 * np.exp(-v)
        return 254 if v > 255 else int(v)

    return [np.array([[light(sum(ref[k, i] * p[i] for i in use)) for k in range(3)] for p in c]).reshape(rgb.shape) for use in ((0, 1), (0,), (1,))]


def stained(seed, n=24):
    """A made tile: dark round nuclei of one stain on a paler ground of the other."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    a, b = np.zeros((n, n)), 0.4 + 0.1 * r.random((n, n))
    for cy, cx in ((6, 6), (6, 13), (17, 16)):
        a += 1.6 * (np.hypot(y - cy, x - cx) < 4)
    od = a[..., None] * [0.65, 0.7, 0.29] + b[..., None] * [0.07, 0.99, 0.11] + 0.2
    return np.clip(240 * np.exp(-od), 1, 255).astype(np.uint8)


def test_stains():
    from tessella.plans.projections import stain_normalise

    rgb = stained(1)
    for got, want in zip(stain_normalise(rgb), plain_stains(rgb), strict=True):
        assert np.abs(got.astype(int) - want).max() <= 1
    assert stain_normalise(np.full((4, 4, 3), 250)) is None


def plain_disk(a, r, pick):
    h, w = a.shape
    return np.array([[pick(a[j, i] for j in range(max(0, y - r), min(h, y + r + 1)) for i in range(max(0, x - r), min(w, x + r + 1)) if (j - y) ** 2 + (i - x) ** 2 <= r * r) for x in range(w)] for y in range(h)])


def test_histology_mask():
    from tessella.plans.aligning import histology_mask

    rgb = stained(2)
    big = rgb.repeat(2, 0).repeat(2, 1)
    grey = plain_stains(big)[1] @ np.array([0.2125, 0.7154, 0.0721]) / 255
    for pick in (min, max, max, min):
        grey = plain_disk(grey, 2, pick)
    t = float(np.median(np.unique(grey)))
    mask = grey > t
    for lab, least, value in ((brute_labels(mask, CROSS), 30, False), (None, 60, True)):
        lab = brute_labels(~mask, CROSS) if lab is None else lab
        for k in range(1, lab.max() + 1):
            if (lab == k).sum() < least:
                mask[lab == k] = value
    mask = plain_disk(plain_disk(mask, 1, max), 1, min)
    got, label = histology_mask(rgb, t)
    assert (got == mask).mean() > 0.99 and 0.05 < mask.mean() < 0.95
    assert (label > 0).sum() <= got.sum() and label.max() >= 1


def test_equalisation_maps_are_the_blocks_own():
    from tessella.plans.projections import clahe

    a = np.random.default_rng(3).integers(0, 256, (16, 16))
    got = clahe(a, clip=2.0, grid=1)
    n = np.bincount(a.reshape(-1), minlength=256).astype(float)
    limit = max(1.0, 2.0 * 256 / 256)
    n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
    assert (got == np.round(np.cumsum(n) * 255 / 256)[a]).all()


def test_watershed_parts_what_a_neck_joins():
    y, x = np.mgrid[:30, :50]
    two = (np.hypot(y - 15, x - 13) < 9) | (np.hypot(y - 15, x - 35) < 9) | ((abs(y - 15) < 2) & (x > 13) & (x < 35))
    lab = masks.watershed_image(two, 30)
    assert lab.max() == 2 and lab[15, 13] != lab[15, 35] and ((lab > 0) == two).all()
    for k in (1, 2):
        assert brute_labels(lab == k, CROSS).max() == 1


def test_homography_over_all_pairs_is_the_direct_fit(spark):
    r = np.random.default_rng(4)
    s = r.random((300, 2)) * 900
    m = np.array([[1.01, 0.02, 5], [-0.015, 0.99, 3], [1e-5, 2e-5, 1]])
    q = np.c_[s, np.ones(300)] @ m.T
    d = q[:, :2] / q[:, 2:] + r.normal(size=(300, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in np.c_[s, d]], "sx double, sy double, dx double, dy double")
    assert np.allclose(fitting.homography_over(df), fitting.homography_fit(s, d), atol=1e-6)


def test_too_many_controls_are_an_error(spark):
    df = spark.range(fitting.MAX_CONTROLS + 1).selectExpr("cast(id as double) sx", "0D sy", "0D dx", "0D dy")
    with pytest.raises(ValueError):
        fitting.spline_from(df)
