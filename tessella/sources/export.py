"""Tiles and patches cut from image files, files written by executors, and tiled images of any size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from .images import DEFLATE, Tiff, opened, write_png

MANIFEST_DDL = "path string, n_bytes long"


def _over_image(boxes: DataFrame, path: str, level: int, one: Callable[[Tiff, object], bytes | None], keep: Sequence[str], name: str) -> DataFrame:
    """``one(image, row)`` for every row, with the image opened once a batch and read by windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as f:
            image = Tiff(lambda at, n: f.read_at(n, at), level)
            for pdf in batches:
                yield pdf[list(keep)].assign(**{name: [one(image, r) for r in pdf.itertuples()]})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*keep).schema)
    return boxes.mapInPandas(run, f"{ddl}, `{name}` binary")


def stretched(a: np.ndarray) -> np.ndarray:
    """16 bits as an 8-bit preview, by minimum and maximum, truncated; a constant image is 0."""
    lo, hi = float(a.min()), float(a.max())
    return np.trunc(np.round((a - lo) * 255.0 / (hi - lo + 1e-8), 9)).astype(np.uint8)


def cut(boxes: DataFrame, path: str, level: int = 0, preview: bool = False, keep: Sequence[str] = ("tile_id",), box: Sequence[str] = ("cx0", "cy0", "cx1", "cy1")) -> DataFrame:
    """Each box (inside the image, not empty) as a PNG in ``content``, in the image's bits and bands or as 8-bit preview.

    There is no shuffle: a task reads the strips or tiles that its boxes meet. Order boxes by place if the image's tiles are large.
    """

    def one(image: Tiff, r) -> bytes:
        x0, y0, x1, y1 = (int(getattr(r, c)) for c in box)
        a = image.window(y0, y1, x0, x1)
        return write_png(stretched(a) if preview else a)

    return _over_image(boxes.select(*dict.fromkeys([*keep, *box])), path, level, one, keep, "content")


def bilinear(image: Tiff, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image at places, zero beyond its edge, rounded half to even; only the window around the places is read."""
    h, w, bands = image.shape
    ix, iy = np.floor(x), np.floor(y)
    fx, fy = x - ix, y - iy
    ix, iy = np.clip(ix, -2, w + 1).astype(int), np.clip(iy, -2, h + 1).astype(int)
    x0, y0 = max(0, int(ix.min())), max(0, int(iy.min()))
    a = image.window(y0, int(iy.max()) + 2, x0, int(ix.max()) + 2).astype(float)
    total = np.zeros((*x.shape, bands))
    if not a.size:
        return total.astype(image.kind.newbyteorder("="))
    for dy in (0, 1):
        for dx in (0, 1):
            row, col = iy + dy - y0, ix + dx - x0
            inside = (row >= 0) & (row < a.shape[0]) & (col >= 0) & (col < a.shape[1])
            weight = np.where(inside, (fy if dy else 1 - fy) * (fx if dx else 1 - fx), 0.0)
            total += weight[..., None] * a[np.clip(row, 0, a.shape[0] - 1), np.clip(col, 0, a.shape[1] - 1)]
    return np.rint(np.round(total, 9)).astype(image.kind.newbyteorder("="))


def _projected(m, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v, w = (row[0] * x + row[1] * y + row[2] for row in m)
    w = np.where(np.abs(w) > 1e-9, w, np.where(w < 0, -1e-9, 1e-9))
    return u / w, v / w


def rectified(boxes: DataFrame, path: str, m, level: int = 0, keep: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Boxes (x0, y0, w, h) seen through ``m`` and straightened, as PNG; boxes that fall wholly outside the image go.

    The result's corners are those of the box, its sides the means of opposite edges, rounded half to even, at least 2. Four
    corners fix a homography, which is thus that of the box followed by ``m``.
    """

    def one(image: Tiff, r) -> bytes | None:
        x, y = _projected(m, r.x0 + r.w * np.array([0, 1, 1, 0]), r.y0 + r.h * np.array([0, 0, 1, 1]))
        if x.min() >= image.shape[1] or x.max() <= 0 or y.min() >= image.shape[0] or y.max() <= 0:
            return None
        edge = np.hypot(np.roll(x, -1) - x, np.roll(y, -1) - y)  # top, right, bottom, left
        rw, rh = (max(2, int(np.rint((edge[k] + edge[k + 2]) / 2))) for k in (0, 1))
        j, i = np.meshgrid(np.arange(rw) / (rw - 1), np.arange(rh) / (rh - 1))
        return write_png(bilinear(image, *_projected(m, r.x0 + j * r.w, r.y0 + i * r.h)))

    return _over_image(boxes.select(*keep, "x0", "y0", "w", "h"), path, level, one, keep, "content").where("content is not null")


def registered(grid: DataFrame, path: str, inverse, tile: int, level: int = 0) -> DataFrame:
    """Packed tiles (i, content) of the registered image: each pixel of the target looked up through ``inverse``.

    A task holds one tile and the window of the source that it maps to.
    """

    def one(image: Tiff, r) -> bytes:
        j, i = np.meshgrid(np.arange(r.w, dtype=float), np.arange(r.h, dtype=float))
        a = bilinear(image, *_projected(inverse, r.x0 + j, r.y0 + i))
        return packed(np.pad(a, ((0, tile - len(a)), (0, tile - a.shape[1]), (0, 0))))

    return _over_image(grid.withColumnRenamed("tile_id", "i"), path, level, one, ["i"], "content")


def packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype(a.dtype.newbyteorder("<")).tobytes())


def packed_tiles(pixels: DataFrame, width: int, tile: int, bands: Sequence[str] = ("v",), bits: int = 16) -> DataFrame:
    """The same of pixel rows (y, x, bands): one shuffle, to a task for each tile."""
    across = -(-width // tile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((tile, tile, len(bands)), dtype=np.uint16 if bits == 16 else np.uint8)
        a[pdf["y"] % tile, pdf["x"] % tile] = pdf[list(bands)]
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "content": [packed(a)]})

    i = F.floor(F.col("y") / tile) * across + F.floor(F.col("x") / tile)
    return pixels.select(i.cast("long").alias("i"), "y", "x", *bands).groupBy("i").applyInPandas(run, "i long, content binary")


def big_tiff_head(width: int, height: int, bands: int, bits: int, tile: int, sizes: Sequence[int], description: str = "") -> bytes:
    """Header and directory of a BigTIFF of deflated tiles, whose bytes follow in order."""

    def packed_values(kind: int, values) -> bytes:
        return values if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", *values)

    tags = {
        256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * bands), 259: (3, [DEFLATE]), 262: (3, [2 if bands == 3 else 1]),
        277: (3, [bands]), 322: (4, [tile]), 323: (4, [tile]), 324: (16, [0] * len(sizes)), 325: (16, list(sizes)),
    }
    if description:
        tags[270] = (2, description.encode() + b"\0")
    far = 16 + 8 + 20 * len(tags) + 8
    begin = far + sum(n for n in (len(packed_values(*t)) for t in tags.values()) if n > 8)
    tags[324] = (16, (begin + np.cumsum([0, *sizes[:-1]])).tolist())
    entries, rest = b"", b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = packed_values(kind, values)
        if len(raw) > 8:
            raw, rest = struct.pack("<Q", far + len(rest)), rest + raw
        entries += struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0")
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + rest


def write_big_tiff(tiles: DataFrame, path: str, width: int, height: int, tile: int, bands: int = 1, bits: int = 16, description: str = "") -> str:
    """One tiled BigTIFF of packed tiles (i, content) in rows; tiles that aren't there have no bytes and read as zero.

    Tiles are made on the executors and kept in the shared folder. The driver gets their lengths (16 bytes a tile), then
    passes one partition at a time on to the file, which appears under its name only when it is whole.
    """
    kept = written(tiles.select("i", "content"))
    sizes = [0] * (-(-width // tile) * -(-height // tile))
    for i, n in kept.select("i", F.octet_length("content")).collect():
        sizes[i] = n
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at + ".part") as out:
        out.write(big_tiff_head(width, height, bands, bits, tile, sizes, description))
        for r in kept.orderBy("i").toLocalIterator():
            out.write(bytes(r.content))
    system.move(at + ".part", at)
    return path


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) rows as files of a folder, from the executors; what was written, as (path, n_bytes).

    A file takes its name when it is whole, and a task that runs again writes the same file again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                part = f"{at}/.{name}.{np.random.SeedSequence().entropy:x}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(content))
                system.move(part, f"{at}/{name}")
            yield pd.DataFrame({"path": pdf["path"], "n_bytes": pdf["content"].map(len).astype("int64")})

    return written(files.select("path", "content").mapInPandas(run, MANIFEST_DDL))
