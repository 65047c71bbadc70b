"""Image formats, windowed reads, files written by executors, and the SQL functions over images."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import registered
from tessella.operators import fitting, masks
from tessella.plans.aligning import dark_nuclei_mask, histology_mask
from tessella.sources import artefacts, export, images


@pytest.mark.parametrize("kind", ["text", "zeros", "noise", "empty"])
def test_lzw_round_trip(kind):
    rng = np.random.default_rng(3)
    data = {"text": b"tobeornottobe" * 900, "zeros": bytes(90_000), "noise": rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), "empty": b""}[kind]
    assert images.unlzw(images.lzw(data)) == data


def test_lzw_of_the_specification():
    # codes 256 7 258 8 8 258 6 6 257, nine bits each, for the TIFF specification's example
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    want = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert images.unlzw(packed) == want and images.lzw(want) == packed


def test_lzw_tiff_keeps_its_description():
    a = np.random.default_rng(0).integers(0, 9, (40, 30, 3)).astype(np.uint8)
    data = images.write_tiff([a, a[::2, ::2]], packed_lzw=True, description=artefacts.ome_xml(0.5, 0.25))
    assert (images.read_tiff(data) == a).all() and (images.read_tiff(data, 1) == a[::2, ::2]).all()
    assert b'PhysicalSizeX="0.5"' in images.tiff_directories(data)[0][270][0] and 270 not in images.tiff_directories(data)[1]


def test_directories_in_a_circle_are_an_error():
    data = bytearray(images.write_tiff([np.zeros((2, 2), np.uint8)]))
    data[-4:] = data[4:8]
    with pytest.raises(ValueError, match="circle"):
        images.tiff_directories(bytes(data))


def planar_tiff(a):
    """A big-endian TIFF with its bands one after another, in strips of two rows."""
    h, w, n = a.shape
    strips = [a[y : y + 2, :, k].astype(">u2").tobytes() for k in range(n) for y in range(0, h, 2)]
    head, body, starts = 8, b"".join(strips), []
    for s in strips:
        starts.append(head)
        head += len(s)
    lists = struct.pack(f">{len(strips)}I", *starts) + struct.pack(f">{len(strips)}I", *map(len, strips))
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, len(strips), head), (277, 3, 1, n << 16),
            (278, 4, 1, 2), (279, 4, len(strips), head + 4 * len(strips)), (284, 3, 1, 2 << 16)]
    entries = b"".join(struct.pack(">HHII", *t) for t in tags)
    return b"MM" + struct.pack(">HI", 42, head + len(lists)) + body + lists + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0)


def test_planar_big_endian():
    a = np.random.default_rng(1).integers(0, 60_000, (5, 4, 3)).astype(np.uint16)
    assert (images.read_tiff(planar_tiff(a)) == a).all()
    assert (images.Tiff(planar_tiff(a)).window(1, 4, 2, 9) == a[1:4, 2:]).all()


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    a = np.random.default_rng(2).integers(1, 60_000, (150, 200)).astype(np.uint16)
    a[64:128, 64:128] = 0
    rows = images.pixels_of(a[..., None], "a")
    path = str(tmp_path_factory.mktemp("big") / "a.tif")
    px = spark.createDataFrame(rows[rows["v"] > 0])
    return a, export.write_big_tiff(export.packed_tiles(px, 200, 64), path, 200, 150, 64, description=artefacts.ome_xml(0.5, 0.25))


def test_big_tiff(spark, big):
    a, path = big
    data = open(path, "rb").read()
    assert data[2] == 43 and (images.read_tiff(data)[..., 0] == a).all()
    tags = images.tiff_directories(data)[0]
    assert tags[325][5] == 0 and b"PhysicalSizeY" in tags[270][0]  # the empty tile has no bytes
    assert not [f for f in os.listdir(os.path.dirname(path)) if f.endswith(".part")]


def test_a_window_fetches_only_its_tiles(big):
    a, path = big
    data, got = open(path, "rb").read(), []

    def fetch(at, n):
        got.append(n)
        return data[at : at + n]

    image = images.Tiff(fetch)
    got.clear()
    assert (image.window(130, 150, 10, 50)[..., 0] == a[130:150, 10:50]).all() and len(got) == 1
    assert image.window(500, 600).shape == (0, 200, 1)


def test_source_reads_its_rows(spark, big):
    a, path = big
    spark.dataSource.register(images.ImageSource)
    rows = spark.read.format("tissue_image").option("path", path).option("rows", "25").option("y0", "30").option("y1", "80").load()
    assert rows.rdd.getNumPartitions() == 2
    assert rows.agg(F.min("y"), F.max("y"), F.sum("v")).first()[:] == (30, 79, int(a[30:80].sum()))


def test_jpeg(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(8):
        for x in range(16):
            image.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    got = {r.band: (r.n, r.v) for r in images.read_jpegs(spark, str(tmp_path)).groupBy("band").agg(F.count("*").alias("n"), F.avg("v").alias("v")).collect()}
    assert all(got[k][0] == 128 and abs(got[k][1] - v) < 4 for k, v in enumerate((200, 100, 50)))


def test_files_are_written_whole(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(20)], "path string, content binary")
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # a task that runs again does no harm
        assert export.write_files(files, folder).agg(F.sum("n_bytes")).first()[0] == 190
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{i}.bin" for i in range(20))
    assert (tmp_path / "out" / "7.bin").read_bytes() == bytes([7]) * 7


def test_read_or_build_builds_once(spark, tmp_path):
    for n in (3, 9):
        assert artefacts.read_or_build(spark, str(tmp_path / "t"), lambda n=n: spark.range(n)).count() == 3


def test_constant_preview_is_zero():
    assert not export.stretched(np.full((3, 3), 700, np.uint16)).any()


def test_spline_in_sql(spark):
    registered.register(spark)
    rng = np.random.default_rng(4)
    s, d = rng.random((12, 2)) * 50, rng.random((12, 2)) * 50
    spark.createDataFrame(np.c_[s, d].tolist(), "sx double, sy double, dx double, dy double").createOrReplaceTempView("sql_pairs")
    got = spark.sql("WITH f AS (SELECT fit_tps(sx, sy, dx, dy) AS m FROM sql_pairs) SELECT img_tps_x(m, sx, sy), img_tps_y(m, sx, sy) FROM f, sql_pairs ORDER BY sx").collect()
    model = fitting.spline_fit(s, d)
    x, y = fitting.spline_xy(model, F.col("sx"), F.col("sy"))
    want = spark.table("sql_pairs").select(x, y, "sx").orderBy("sx").collect()
    assert np.allclose([r[:] for r in got], [r[:2] for r in want])
    assert spark.sql("SELECT fit_tps(1D, 2D, 3D, 4D) AS m").first().m is None


def test_masks_in_sql(spark):
    registered.register(spark)
    a = np.random.default_rng(5).integers(0, 256, (12, 10))
    rgb = np.random.default_rng(6).integers(0, 256, (9, 8, 3))
    rows = [(1, a.reshape(-1).tolist(), rgb.reshape(-1).tolist()), (2, None, None)]
    spark.createDataFrame(rows, "k int, v array<int>, c array<int>").createOrReplaceTempView("sql_images")
    sql = "SELECT label_components(transform(v, e -> int(e > 150)), 10) AS l, nuclei_mask_dapi(v, 10) AS d, nuclei_mask_he(c, 8) AS h FROM sql_images ORDER BY k"
    got, none = spark.sql(sql).collect()
    assert got.l == masks.label_image(a > 150).reshape(-1).tolist()
    assert got.d == dark_nuclei_mask(a.astype(float)).reshape(-1).tolist()
    assert got.h == histology_mask(rgb.astype(float))[1].reshape(-1).tolist()
    assert none[:] == (None, None, None)
