"""Registration of queries. One column spec shapes the Spark result and its SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.plans.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select the spec's columns: i bigint, d double rounded to 6 places, s string, b boolean."""
    as_type = {
        "i": lambda c: c.cast("bigint"),
        "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
        "s": lambda c: c.cast("string"),
        "b": lambda c: c.cast("boolean"),
    }
    return df.select(*[as_type[t](F.col(n)).alias(n) for n, t in _columns(spec)])


def shape_sql(sql: str, spec: str) -> str:
    as_type = {
        "i": "CAST({} AS BIGINT)", "d": "round(CAST({} AS DOUBLE), 6) + 0.0",
        "s": "CAST({} AS VARCHAR)", "b": "CAST({} AS BOOLEAN)",
    }
    cols = ", ".join(f"{as_type[t].format(n)} AS {n}" for n, t in _columns(spec))
    return f"SELECT {cols} FROM ({sql}) AS shaped"


def query(spec: str, sql: str | None = None):
    """Register a function of ``Tables``; its name is the query's name."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: shape(fn(Tables(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[fn.__name__] = shape_sql(sql, spec)
        return fn

    return register
