"""Cutting lineage by written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where executors share the driver's disk, as in tests, is an unset one replaced by a temporary folder of our own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own[app]


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder; removed when the program ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
