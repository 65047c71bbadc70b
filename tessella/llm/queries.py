"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, linedup, pii, simhash, substring, suffix, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of a benchmark window), n_items, items_sha256, contaminated.

    A null or empty text has no words, hits nothing and isn't contaminated; an item with a null id or
    without words is never found, one that comes twice counts once. Documents that repeat an id or a text each
    have their row. An empty benchmark hits nothing; an empty table gives no rows. Other columns aren't read.
    """
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id (least doc_id reached by links of 2 or fewer differing bits).

    A null, empty or blank text has fingerprint 0, which links like any other. A null id takes part and
    names a component only if all ids of it are null. Repeated rows each have theirs; an empty table gives none.
    """
    return simhash.report(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed (words covered by a repeated window of 35), kept_sha256.

    A null or empty text has no words. Rows that repeat a text, with one id or two, repeat all its windows.
    Texts of any length are handled whole; an empty table gives no rows. Other columns aren't read.
    """
    return substring.report(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (least vec_id reached), kept.

    Null, empty and zero vectors, those with null or non-finite components, and those with a null label link with
    nothing and are kept. Vectors of different length don't link. Repeated rows are vectors of their own.
    """
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed (bytes covered by a repeated string of 400), n_spans, kept_sha256.

    A null text counts as empty. Rows that repeat a text, with one id or two, repeat all its strings. Texts of any length
    are handled whole; an empty table gives no rows. Other columns aren't read.
    """
    return suffix.report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (ids of up to three nearest examples).

    A null or empty text, like any without a term of the model, has the share of toxic ones among such examples. A document with
    several labels is toxic if one says so; null labels are ignored. Without labels all score 0. Equal cosines go to the
    example that comes first in the index. A null id isn't held out.
    """
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of the whole text.

    A null or empty text has no tokens. Repeated rows each have theirs; an empty table gives none. Other columns aren't read.
    """
    return bpe.report(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_licenses, licenses (names in order, comma-joined).

    A null or empty text, and one of fewer than five words, holds none. A license found several times is named once.
    """
    return licenses.report(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, counts of the fixed patterns' spans, base_sha256, spans (all), n_secret, n_spans.

    A null or empty text has none. Of kinds at one start the one listed first comes first; the field's spans touch no fixed span.
    Repeated rows each have theirs; an empty table gives none. Other columns aren't read.
    """
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines that ten or more sites hold), kept_sha256.

    A null text has no lines, an empty one has one, blank, which stays. Null sites don't count. Repeated
    rows are treated alike; an empty table gives none.
    """
    return linedup.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontaminate, op2_substring_dedup, op3_simhash, op4_embedding_dedup, op5_suffix_dedup,
        op6_toxicity, op7_bpe, op8_licenses, op9_pii, op10_line_dedup,
    )
    return {f.__name__: f for f in own}
