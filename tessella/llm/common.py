"""What the training-data operators share: stashing, bounded broadcasts, vectorised words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import drop as _drop
from ..lineage import written as stash

U64 = np.uint64
#: Bytes of text that a kernel handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: A side of a join is broadcast only when its rows, counted before, stay below this.
BROADCAST_ROWS = 200_000
#: Likewise, where rows hold arrays: the bytes of all of them.
BROADCAST_BYTES = 64 << 20
#: Stands for a null document id inside joins; never shown.
NO_ID = -(1 << 63)

def bucketed(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``df`` as a table in n buckets of ``keys``: one shuffle, after which joins on them move the other side only."""
    spark = df.sparkSession
    name = f"tessella_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("compression", "zstd").saveAsTable(name)
    atexit.register(_drop_table, spark, name)
    return spark.table(name)


def _drop_table(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """A small frame kept by the executors, and its rows; what a lost executor held is computed again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def unstash(df: DataFrame) -> None:
    """Delete the files of a stashed frame that nothing will read again."""
    for path in df.inputFiles()[:1]:
        _drop(df.sparkSession, path.rsplit("/", 1)[0])


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows are few; otherwise Spark shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def texts_of(docs: DataFrame, text_col: str = "text", *more: Column, keep: list[str] | None = None) -> DataFrame:
    """(_row, more, _text): a document's columns (or those of ``keep``) in a struct, so that no name clashes, and its text.

    Rows hold whole texts, so Arrow batches of Spark's default size are made smaller.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"), *more, F.col(text_col).alias("_text"))


def small_batches(spark: SparkSession, rows: int = 4000, size: str = "2m") -> None:
    """Sets the rows and bytes of an Arrow batch for this session, where they are still Spark's defaults."""
    for name, default, own in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def give_back() -> None:
    """Return what this worker has freed to the system: an idle worker, kept for later stages, else holds on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of ``mapInArrow``, after which a worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return run


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Join key of a document: its id (a null one has a stand-in) and a hash of its text.

    Rows that repeat both are the same document for joins, and get the same answer.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_t"),
    ]


def chunked(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of which the texts in ``column`` hold about ``limit`` bytes at most."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size)
    lo, n = 0, len(size)
    while lo < n:
        base = run[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(run, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**j`` and its inverse modulo 2**64, for j up to n."""
    if k not in _pow or len(_pow[k][0]) <= n:
        size = (n // 65536 + 1) * 65536 + 1
        b = _BASES[k]
        out = []
        for x in (b, pow(b, -1, 1 << 64)):
            a = np.full(size, x, dtype=U64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U64))
        _pow[k] = (out[0], out[1])
    p, q = _pow[k]
    return p[: n + 1], q[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


#: Odd multipliers of the two families of hashes.
STEP = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))


def doubled(ids: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive values, by doubling: each round mixes what the round before made.

    Unlike polynomials modulo 2**64, which all odd bases send to one value for some texts, a mixed
    hash isn't linear, so no text collides by its letters' pattern.
    """
    if len(ids) < n:
        return ids[:0]
    have = 1
    while have * 2 <= n:
        ids = mix(ids[:-have] * STEP[k] + ids[have:])
        have *= 2
    rest = n - have
    return mix(ids[:-rest] * STEP[1 - k] + ids[rest:]) if rest else ids


def digest(buf: bytes, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH3 of the slices [lo, hi) of a buffer."""
    xx = xxhash.xxh3_64_intdigest
    return np.fromiter((xx(buf[s:e], seed) for s, e in zip(lo.tolist(), hi.tolist(), strict=True)), dtype=U64, count=len(lo))


def prefix(values: np.ndarray, k: int) -> np.ndarray:
    """Prefix sums of ``values[j] * base**j``: the hash of any slice follows from two of them."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64) * powers(len(values), k)[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the slices [lo, hi)."""
    return mix((sums[hi] - sums[lo]) * powers(len(sums), k)[1][lo])


class Digests(dict):
    """XXH3 of words; remembers those of usual length."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


class Words:
    """The words of some texts, one after another, as bounds in one buffer.

    ``split`` cuts at blanks and ASCII control spaces; ``table`` may first map other bytes to blanks.
    """

    def __init__(self, texts: list[bytes | None], table: bytes | None = None, lower: bool = False):
        parts: list[bytes] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                w = (t.translate(table) if table else t.lower() if lower else t).split()
                counts[i] = len(w)
                parts += w
        self.n = counts
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.buf = b" ".join(parts)
        self.bytes = np.frombuffer(self.buf, dtype=np.uint8)
        if parts:
            gaps = np.flatnonzero(self.bytes == 32)
            self.start = np.concatenate([[0], gaps + 1])
            self.end = np.concatenate([gaps, [len(self.bytes)]])
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.parts = parts

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, k: int = 0) -> np.ndarray:
        return between(prefix(self.bytes + np.uint8(1), k), self.start, self.end, k)

    def digests(self, memory: Digests) -> np.ndarray:
        """XXH3 of each word."""
        return np.fromiter(map(memory.__getitem__, self.parts), dtype=U64, count=len(self.parts))


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected links (u, v) by alternating large-star and small-star steps.

    Returns (u, root) for each node that isn't its component's smallest one. Every step is a
    distributed aggregate and join; each round is stashed, so lineage stays short.
    """
    e = stash(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seal = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        fresh = stash(small)
        now = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstash(e)
        e = fresh
        if now == seal:
            break
        seal = now
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    return e.select("u", F.col("v").alias("root"))
