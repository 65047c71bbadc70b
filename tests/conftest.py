"""One Spark session for all tests, and the driver's smallest tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


def canonical(rows):
    """Rows as a sorted list; floats to nine digits."""

    def plain(x):
        if isinstance(x, float):
            return None if x != x else float(f"{x:.9g}") + 0.0
        return x

    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Compares a frame with SQL by column names and values."""

    def check(df, sql):
        cols = sorted(df.columns)
        got = canonical(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        names = ", ".join(f'"{c}"' for c in cols)
        assert sorted(duck.sql(sql).columns) == cols
        want = canonical(duck.sql(f"SELECT {names} FROM ({sql})").fetchall())
        assert got == want

    return check
