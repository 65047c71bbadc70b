"""Cross-site boilerplate lines, by DataFrame functions alone.

HyperLogLog sketches of the sites of each line merge by aggregation; lines whose estimate is near
the threshold get an exact distinct count. Lines spread over that many sites are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, held

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and the relative distance from the threshold within which it isn't trusted.
LG_K, MARGIN = 10, 0.35


def _line(raw: Column) -> Column:
    """A line as compared: without blanks and carriage returns around it."""
    return F.btrim(raw, F.lit(" \t\r"))


def line_keys(text: Column) -> Column:
    """Array of the 128-bit keys of a text's lines, as structs; null for blank lines."""

    def key(raw: Column) -> Column:
        x = _line(raw)
        return F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))

    return F.transform(F.split(text, "\n", -1), key)


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (a, b) of the lines that ``min_sites`` distinct sites or more hold. Null sites don't count.

    Only lines that occur at least ``min_sites`` times can qualify; the others, nearly all, need no
    sketch. Sketches merge per line over all partitions, so a line of any frequency costs one small
    row a task. Between (1 - MARGIN) and (1 + MARGIN) times the threshold, sites are counted exactly.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(site_col).isNotNull()).select(
        F.col(site_col).alias("site"), F.explode(line_keys(F.col(text_col))).alias("k")
    ).where("k is not null").select("site", "k.a", "k.b")
    often = held(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("a", "b"))
    rows = rows.join(bounded(*often), ["a", "b"], "left_semi")
    spread, _ = held(
        rows.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
        .select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    low, high = (1 - MARGIN) * min_sites, (1 + MARGIN) * min_sites
    near = spread.where(F.col("sites").between(low, high)).select("a", "b")
    exact = (
        rows.join(bounded(near), ["a", "b"], "left_semi")
        .groupBy("a", "b").agg(F.countDistinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > high).select("a", "b").unionByName(exact.select("a", "b"))


def dedup_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, keep: list[str] | None = None) -> DataFrame:
    """Documents without their boilerplate lines.

    Returns ``_row`` (struct of the document's columns as they were, or of those in ``keep``), ``_kept`` (the remaining lines,
    joined by newlines; null for a null text), ``_n_lines`` and ``_n_removed`` (0 for a null text).
    Blank lines are never removed. A document of boilerplate only keeps an empty text. Repeated
    documents are each treated alike.
    """
    bad, n_bad = held(boilerplate(docs, text_col, site_col, min_sites))
    text = F.col(text_col)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"),
        text.alias("_text"),
        F.xxhash64(text).alias("_t1"),
        F.xxhash64(F.lit(7), text).alias("_t2"),
    )
    lines = docs.where(text.isNotNull()).select(
        F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(7), text).alias("_t2"), F.explode(line_keys(text)).alias("k")
    ).where("k is not null").select("_t1", "_t2", "k.a", "k.b")
    hits, n_hits = held(
        lines.join(bounded(bad, n_bad), ["a", "b"]).groupBy("_t1", "_t2")
        .agg(F.collect_set(F.struct("a", "b")).alias("_bad"))
    )
    joined = rows.join(bounded(hits, n_hits, BROADCAST_ROWS // 2), ["_t1", "_t2"], "left")
    all_lines = F.split("_text", "\n", -1)
    kept = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col("_bad"), F.struct(F.xxhash64(_line(x)).alias("a"), F.xxhash64(F.lit(7), _line(x)).alias("b"))), F.lit(False)) | (_line(x) == ""))
    sized = joined.select(
        "_row",
        F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("_kept"),
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("_n_lines"),
        F.when(F.col("_bad").isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias("_n_removed"),
    )
    return sized.withColumn("_n_lines", F.when(F.col("_kept").isNull(), 0).otherwise(F.col("_n_lines")).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept text, one row a document."""
    done = dedup_lines(docs, keep=["doc_id"])
    return done.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )
