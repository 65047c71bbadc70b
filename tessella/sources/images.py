"""Image files as pixel rows: PNG, portable anymaps, TIFF and BigTIFF (strips or tiles, pages and sub-images), JPEG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIXEL_DDL = "image_id string, level int, band int, y int, x int, v int"


def _unfilter(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    """Undo PNG's row filters."""
    out = np.zeros((h, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(h):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, dtype=np.uint8, count=stride, offset=y * (stride + 1) + 1).copy()
        if kind == 1 or kind == 3 or kind == 4:
            for x in range(stride):
                a = int(line[x - bpp]) if x >= bpp else 0
                b = int(above[x])
                c = int(above[x - bpp]) if x >= bpp else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    near = [(abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)]
                    add = min(near)[2]
                line[x] = (int(line[x]) + add) & 255
        elif kind == 2:
            line += above
        out[y] = above = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """(H, W, bands); 8 or 16 bits, grey or colour, with or without alpha, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, colour, _, _, lace = head
    if depth not in (8, 16) or colour not in (0, 2, 4, 6) or lace:
        raise ValueError("unsupported PNG variant")
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    size = depth // 8
    rows = _unfilter(zlib.decompress(idat), h, w * bands * size, bands * size)
    return rows.view(">u2" if size == 2 else np.uint8).reshape(h, w, bands)


def write_png(a: np.ndarray) -> bytes:
    """Grey or colour array of 8 or 16 bits as PNG."""
    a = a[..., None] if a.ndim == 2 else a
    wide = a.dtype.itemsize == 2
    body = a.astype(">u2").view(np.uint8) if wide else a.astype(np.uint8)
    rows = body.reshape(a.shape[0], -1)
    raw = np.c_[np.zeros(len(rows), dtype=np.uint8), rows].tobytes()
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16 if wide else 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pnm_head(data: bytes) -> tuple[tuple[int, int, int], str, int]:
    """Shape, type and place of the values of a P5 or P6 file."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    w, h, top = map(int, fields[1:])
    return (h, w, {b"P5": 1, b"P6": 3}[fields[0]]), ">u2" if top > 255 else "u1", at + 1


def read_pnm(data: bytes) -> np.ndarray:
    """P5 and P6."""
    shape, kind, at = pnm_head(data)
    return np.frombuffer(data, dtype=kind, offset=at, count=shape[0] * shape[1] * shape[2]).reshape(shape)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: 9 to 12 bits, highest first, widened one code early; 256 clears the table, 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = have = 0
    width = 9
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _lzw_codes(data: bytes) -> Iterator[tuple[int, int]]:
    """Codes and their widths."""
    single = {bytes([i]): i for i in range(256)}
    table, free, width, held = dict(single), 258, 9, b""
    yield 256, width
    for i in range(len(data)):
        byte = data[i : i + 1]
        if held + byte in table:
            held += byte
            continue
        yield table[held], width
        table[held + byte] = free
        free, held = free + 1, byte
        width += free == 1 << width
        if free == 4095:
            yield 256, width
            table, free, width = dict(single), 258, 9
    if held:
        yield table[held], width
        width += free + 1 == 1 << width
    yield 257, width


def lzw(data: bytes) -> bytes:
    """What ``unlzw`` undoes."""
    out, bits, have = bytearray(), 0, 0
    for code, width in _lzw_codes(data):
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1
    return bytes(out) + (bytes([bits << 8 - have]) if have else b"")


#: From a place and a length to the bytes there: a whole file in memory, or a file read at places.
Fetch = Callable[[int, int], bytes]


def fetcher(data: bytes | Fetch) -> Fetch:
    return data if callable(data) else lambda at, n: data[at : at + n]


#: How TIFF's types are laid out, and its numbers for packing (deflate has two).
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def tiff_directories(data: bytes | Fetch) -> list[dict[int, list]]:
    """Directories of a TIFF or BigTIFF, sub-images after their page; the bytes' order is under key 0."""
    fetch = fetcher(data)
    head = fetch(0, 16)
    end = {b"II": "<", b"MM": ">"}[head[:2]]
    (version,) = struct.unpack(end + "H", head[2:4])
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    many, place = (end + "Q", end + "Q") if version == 43 else (end + "H", end + "I")
    room = struct.calcsize(place)
    seen: set[int] = set()

    def directory(at: int) -> tuple[dict[int, list], int]:
        if at in seen:
            raise ValueError("directories of a TIFF run in a circle")
        seen.add(at)
        ahead = struct.calcsize(many)
        (n,) = struct.unpack(many, fetch(at, ahead))
        body = fetch(at + ahead, n * (4 + 2 * room) + room)
        tags: dict[int, list] = {0: [end]}
        for i in range(n):
            entry = body[i * (4 + 2 * room) : (i + 1) * (4 + 2 * room)]
            tag, kind, count = struct.unpack(end + "HH" + place[1], entry[: 4 + room])
            if kind not in TIFF_TYPES:
                continue
            fmt = end + str(count) + TIFF_TYPES[kind]
            size, raw = struct.calcsize(fmt), entry[4 + room :]
            if size > room:
                raw = fetch(struct.unpack(place, raw)[0], size)
            tags[tag] = list(struct.unpack(fmt, raw[:size]))
        return tags, struct.unpack(place, body[-room:])[0]

    out, at = [], struct.unpack(place, head[8:16] if version == 43 else head[4:8])[0]
    while at:
        tags, at = directory(at)
        out.append(tags)
        out += [directory(sub)[0] for sub in tags.get(330, [])]
    return out


class Tiff:
    """One directory of a TIFF, read by windows: only strips or tiles that a window meets are fetched.

    Uncompressed, LZW, deflate or PackBits; chunky or planar samples of 8 or 16 bits. A tile without bytes is zero.
    """

    def __init__(self, data: bytes | Fetch, level: int = 0):
        self.fetch = fetcher(data)
        self.tags = tags = tiff_directories(self.fetch)[level]
        self.shape = h, w, bands = tags[257][0], tags[256][0], tags.get(277, [1])[0]
        bits, self.packing, self.planar = tags.get(258, [1])[0], tags.get(259, [PLAIN])[0], tags.get(284, [1])[0] == 2
        if bits not in (8, 16) or self.packing not in (PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE):
            raise ValueError("unsupported TIFF variant")
        self.kind = np.dtype(tags[0][0] + ("u2" if bits == 16 else "u1"))
        self.tiled = 322 in tags
        self.tw, self.th = (tags[322][0], tags[323][0]) if self.tiled else (w, min(h, tags.get(278, [h])[0]))
        self.starts, self.counts = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        self.across, self.down = -(-w // self.tw), -(-h // self.th)
        self.deep = 1 if self.planar else bands
        self.segment = lru_cache(32)(self._segment)

    def _segment(self, i: int) -> np.ndarray:
        rows = self.th if self.tiled else min(self.th, self.shape[0] - i % (self.across * self.down) // self.across * self.th)
        if not self.counts[i]:
            return np.zeros((rows, self.tw, self.deep), dtype=self.kind)
        raw = self.fetch(self.starts[i], self.counts[i])
        raw = {PLAIN: bytes, LZW: unlzw, PACKBITS: _packbits}.get(self.packing, zlib.decompress)(raw)
        block = np.frombuffer(raw, dtype=self.kind, count=rows * self.tw * self.deep).reshape(rows, self.tw, self.deep)
        if self.tags.get(317, [1])[0] == 2:
            block = np.cumsum(block, axis=1, dtype=self.kind.newbyteorder("="))
        return block

    def window(self, y0: int = 0, y1: int | None = None, x0: int = 0, x1: int | None = None) -> np.ndarray:
        """(rows, columns, bands) of a window, cut to the image."""
        h, w, bands = self.shape
        y0, x0 = max(0, y0), max(0, x0)
        y1, x1 = max(y0, min(h, h if y1 is None else y1)), max(x0, min(w, w if x1 is None else x1))
        out = np.zeros((y1 - y0, x1 - x0, bands), dtype=self.kind.newbyteorder("="))
        if not out.size:
            return out
        for plane in range(bands if self.planar else 1):
            for i in range(y0 // self.th, -(-y1 // self.th)):
                for j in range(x0 // self.tw, -(-x1 // self.tw)):
                    block = self.segment((plane * self.down + i) * self.across + j)
                    ty, tx = i * self.th, j * self.tw
                    top, left, bottom, right = max(ty, y0), max(tx, x0), min(ty + self.th, y1), min(tx + self.tw, x1)
                    out[top - y0 : bottom - y0, left - x0 : right - x0, plane : plane + self.deep] = block[top - ty : bottom - ty, left - tx : right - tx]
        return out


def read_tiff(data: bytes | Fetch, level: int = 0) -> np.ndarray:
    """One directory of a TIFF, whole."""
    return Tiff(data, level).window()


def write_tiff(levels: list[np.ndarray], deflate: bool = True, packed_lzw: bool = False, description: str = "") -> bytes:
    """Pages of one strip each; the first is the full size, which the description (such as OME's) is of, the others its sub-images."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    levels = [a[..., None] if a.ndim == 2 else a for a in levels]
    first = levels[0]

    def directory(a: np.ndarray, subs: list[int]) -> int:
        raw = a.astype("<u2" if a.dtype.itemsize == 2 else np.uint8).tobytes()
        raw = lzw(raw) if packed_lzw else zlib.compress(raw) if deflate else raw
        at = len(out)
        out.extend(raw)
        tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, a.dtype.itemsize * 8), (259, 3, LZW if packed_lzw else DEFLATE if deflate else PLAIN),
                (262, 3, 2 if a.shape[2] == 3 else 1), (273, 4, at), (277, 3, a.shape[2]), (278, 4, a.shape[0]), (279, 4, len(raw))]
        if subs:
            place = subs[0]
            if len(subs) > 1:
                place = len(out)
                out.extend(struct.pack(f"<{len(subs)}I", *subs))
            tags.append((330, 4, place))
        note = description.encode() + b"\0"
        if description and a is first:
            tags.append((270, 2, len(out)))
            out.extend(note)
        here = len(out) + len(out) % 2
        out.extend(b"\0" * (here - len(out)) + struct.pack("<H", len(tags)))
        for tag, kind, value in sorted(tags):
            count = len(subs) if tag == 330 else len(note) if tag == 270 else 1
            out.extend(struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value)))
        out.extend(struct.pack("<I", 0))
        return here

    subs = [directory(a, []) for a in levels[1:]]
    out[4:8] = struct.pack("<I", directory(levels[0], subs))
    return bytes(out)


def decode(data: bytes, level: int = 0) -> np.ndarray:
    """Any of the formats, by its first bytes."""
    if data[:4] == b"\x89PNG":
        return read_png(data)
    if data[:2] in (b"P5", b"P6"):
        return read_pnm(data)
    if data[:2] in (b"II", b"MM"):
        return read_tiff(data, level)
    raise ValueError("unknown image format")


#: Pixels of small images that make one frame of rows.
FRAME = 250_000


def pixel_frame(named: list[tuple[str, np.ndarray]], level: int = 0) -> pd.DataFrame:
    """Pixel rows of one or more images, (H, W, bands) each."""
    places = [np.indices(a.shape, dtype=np.int32).reshape(3, -1) for _, a in named]
    y, x, band = np.concatenate(places, axis=1)
    return pd.DataFrame({
        "image_id": np.repeat(np.array([name for name, _ in named], dtype=object), [a.size for _, a in named]), "level": np.int32(level),
        "band": band, "y": y, "x": x, "v": np.concatenate([a.reshape(-1) for _, a in named]).astype("int32"),
    })


def pixels_of(a: np.ndarray, image_id: str, level: int = 0) -> pd.DataFrame:
    return pixel_frame([(image_id, a)], level)


def decode_files(files: DataFrame, level: int = 0, missing: str = "error") -> DataFrame:
    """Pixel rows of (path, content); ``missing="skip"`` leaves out what can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list[tuple[str, np.ndarray]] = []
        held = 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    some.append((path, decode(bytes(content), level)))
                except (ValueError, KeyError, struct.error, zlib.error, IndexError):
                    if missing == "skip":
                        continue
                    raise
                held += some[-1][1].size
                if held > FRAME:
                    yield pixel_frame(some, level)
                    some, held = [], 0
        if some:
            yield pixel_frame(some, level)

    return files.select("path", "content").mapInPandas(run, PIXEL_DDL)


def read_images(spark: SparkSession, path: str, glob: str = "*", level: int = 0, missing: str = "error") -> DataFrame:
    """Pixel rows of the image files in a folder, sorted names, read and decoded on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return decode_files(files, level, missing)


def encode_png(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """(path, content) of one grey PNG an image; 16 bits where a value needs them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf["v"].max() > 255
        a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), dtype=np.uint16 if wide else np.uint8)
        a[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"path": [str(pdf[key].iloc[0])], "content": [write_png(a)]})

    return pixels.groupBy(key).applyInPandas(run, "path string, content binary")


def opened(path: str) -> pa.NativeFile:
    """A file, to be read at places, of any file system that Arrow knows; by URI or absolute path."""
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def rows_of(f: pa.NativeFile, level: int, y0: int = 0, y1: int | None = None) -> np.ndarray:
    """Rows of an image. Of TIFF and anymaps only these are read; a PNG is one packed stream, and decoded whole."""
    head = f.read_at(4096, 0)
    if head[:2] in (b"II", b"MM"):
        return Tiff(lambda at, n: f.read_at(n, at), level).window(y0, y1)
    if head[:2] in (b"P5", b"P6"):
        (h, w, n), kind, at = pnm_head(head)
        y1 = h if y1 is None else min(h, y1)
        row = w * n * np.dtype(kind).itemsize
        return np.frombuffer(f.read_at((y1 - y0) * row, at + y0 * row), dtype=kind).reshape(y1 - y0, w, n)
    return decode(f.read_at(f.size(), 0), level)[y0:y1]


def shape_of(f: pa.NativeFile, level: int = 0) -> tuple[int, int]:
    """Height and width, from the head of the file."""
    head = f.read_at(4096, 0)
    if head[:2] in (b"II", b"MM"):
        tags = tiff_directories(lambda at, n: f.read_at(n, at))[level]
        return tags[257][0], tags[256][0]
    if head[:2] in (b"P5", b"P6"):
        return pnm_head(head)[0][:2]
    if head[:4] == b"\x89PNG":
        return struct.unpack(">II", head[16:24])[::-1]
    raise ValueError("unknown image format")


def read_jpegs(spark: SparkSession, path: str, missing: str = "error") -> DataFrame:
    """Pixel rows of JPEG (also BMP and GIF) files, decoded by Spark's own image source; bands in order red, green, blue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                yield pixels_of(np.concatenate([a[..., 2::-1], a[..., 3:]], axis=2) if r.nChannels > 2 else a, r.origin)

    rows = spark.read.format("image").option("dropInvalid", missing == "skip").load(path).select("image.*")
    return rows.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, PIXEL_DDL)


class _Block(InputPartition):
    def __init__(self, path: str, y0: int, y1: int):
        super().__init__((path, y0, y1))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.level = int(options.get("level", "0"))
        self.rows = int(options.get("rows", "1024"))
        self.y0, self.y1 = int(options.get("y0", "0")), int(options.get("y1", str(1 << 40)))

    def partitions(self):
        with opened(self.path) as f:
            h = min(shape_of(f, self.level)[0], self.y1)
        return [_Block(self.path, y, min(h, y + self.rows)) for y in range(self.y0, h, self.rows)]

    def read(self, partition):
        path, y0, y1 = partition.value
        with opened(path) as f:
            a = rows_of(f, self.level, y0, y1)
        step = max(1, 100_000 // max(1, a.shape[1] * a.shape[2]))
        for y in range(0, len(a), step):
            rows = pixels_of(a[y : y + step], path, self.level).assign(y=lambda t, y=y: (t["y"] + y0 + y).astype("int32"))
            yield pa.RecordBatch.from_pandas(rows, schema=_ARROW, preserve_index=False)


_ARROW = pa.schema([("image_id", pa.string()), *((c, pa.int32()) for c in ("level", "band", "y", "x", "v"))])


class ImageSource(DataSource):
    """``spark.read.format("tissue_image")``: one partition a block of rows, of which it alone is read; options path, level, rows, y0, y1.

    The driver reads the head of the file. A PNG can't be read in parts: each of its partitions decodes it.
    """

    @classmethod
    def name(cls):
        return "tissue_image"

    def schema(self):
        return PIXEL_DDL

    def reader(self, schema):
        return _Reader(self.options)


def lut_rows(content: F.Column) -> F.Column:
    """Array of (i, r, g, b) from the 768 bytes of a binary table: all reds, all greens, all blues."""
    code = F.hex(content)

    def byte(k):
        return F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct(i.alias("i"), byte(i).alias("r"), byte(i + 256).alias("g"), byte(i + 512).alias("b")))
