"""Queries with their SQL: both sides go through one list of typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import VIEWS, Source

#: Column kinds: long, double (rounded), the same rounded fast, string, boolean, timestamp.
SPARK = {"l": "long", "d": "double", "f": "double", "s": "string", "b": "boolean", "t": "timestamp"}
DUCK = {"l": "BIGINT", "d": "DOUBLE", "f": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}
DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def rounded(c: Column) -> Column:
    """What F.round(c, DIGITS) gives; it makes a decimal of each number, which is done here only close to ties and for large ones."""
    scaled = c * F.lit(10.0**DIGITS)
    whole = F.rint(scaled)
    return F.when((F.abs(c) < 1e6) & (F.abs(scaled - whole) < 0.499), whole / F.lit(10.0**DIGITS)).otherwise(F.round(c, DIGITS))


def typed(df: DataFrame, spec: str) -> DataFrame:
    """The columns of ``spec`` in their types; doubles rounded to a fixed number of digits."""
    out = []
    for name, kind in _columns(spec):
        c = F.col(name).cast(SPARK[kind])
        if kind in "df":
            c = (rounded(c) if kind == "f" else F.round(c, DIGITS)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def oracle(sql: str, spec: str) -> str:
    """SQL with the adapters that it names in front, and typed columns around it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(body)
                need.append(name)

    add(sql)
    cols = ", ".join(
        f"round(CAST({n} AS DOUBLE), {DIGITS}) + 0.0 AS {n}" if k in "df" else f"CAST({n} AS {DUCK[k]}) AS {n}" for n, k in _columns(spec)
    )
    views = "".join(f"{n} AS ({VIEWS[n]}),\n" for n in need)
    return f"WITH {views}answer AS ({sql})\nSELECT {cols} FROM answer"


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of a Source as a query, with the SQL that it must agree with."""

    def wrap(f: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: typed(f(Source(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[name] = oracle(sql, spec)
        return f

    return wrap
