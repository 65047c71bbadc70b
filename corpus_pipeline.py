"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenisation.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``docs`` for the documents that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, linedup, simhash, toxicity
from tessella.llm.common import NO_ID, bounded, doc_key, stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts have the share of toxic ones among examples without terms, and stay where that is below one half.
    Repeated rows share a score. An empty table stays empty; without labels every score is 0 and all documents stay.
    """
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("_score < 0.5").select("_row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many sites share; ``n_chars`` follows the text.

    A document of boilerplate alone stays, with an empty text.
    """
    same = F.col("_kept").eqNullSafe(F.col("_row.text"))
    changed = {"text": F.col("_kept"), "n_chars": F.when(same, F.col("_row.n_chars")).otherwise(F.length("_kept").cast("long"))}
    # columns come from the struct by name, so that none of the documents' own clashes with the operator's
    return linedup.dedup_lines(docs).select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of least id (of least text hash, if ids repeat).

    Fingerprint 0, which texts without words have, is a component like any other. Of rows that
    repeat the chosen id and text, one stays. A null id comes after all others.
    """
    keys = docs.select(*doc_key(), "text")
    own = stash(simhash.fingerprints(keys, keep=["_id", "_t"]).select(F.struct(F.col("_row._id").alias("doc_id"), F.col("_row._t").alias("t")).alias("_row"), "_fp"))
    groups = simhash.with_components(own)
    order = F.struct((F.col("_row.doc_id") == NO_ID).alias("last"), F.col("_row.doc_id").alias("_id"), F.col("_row.t").alias("_t"))
    rows = groups.select("_root", order.alias("o")).groupBy("_root", "o").agg(F.count("*").alias("n"))
    # the least of a component is marked by a join on both, so that a component of any size spreads over all tasks
    least = rows.groupBy("_root").agg(F.min("o").alias("o")).withColumn("least", F.lit(True))
    fate = stash(rows.join(least, ["_root", "o"], "left").select("o._id", "o._t", F.coalesce("least", F.lit(False)).alias("stays"), "n"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *doc_key())
    gone = fate.where("not stays or n > 1").select("_id", "_t")
    kept = named.join(bounded(gone), ["_id", "_t"], "left_anti").select("_row")
    repeated = fate.where("stays and n > 1").select("_id", "_t")
    n = repeated.count()
    if n:
        once = named.join(bounded(repeated, n), ["_id", "_t"]).groupBy("_id", "_t").agg(F.first("_row").alias("_row"))
        kept = kept.unionByName(once.select("_row"))
    return kept.select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text.

    Null and empty texts have no words and stay; repeated rows share their fate; an empty benchmark drops nothing.
    """
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select("_row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left: one row each, repeated ones too, with no tokens for null and empty texts."""
    return bpe.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can express neither the nearest-example scores, nor XXH64 fingerprints, nor BPE: the tests
#: hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
    return docs
