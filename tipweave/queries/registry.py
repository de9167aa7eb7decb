from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tipweave.runtime import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Tables whose rows are costly to work on, or many.
SPREAD = ("documents", "conversations", "pages", "events", "orders", "part", "customer", "lineitem")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in SPREAD else df


def values(rows) -> str:
    """Rows as the body of an SQL VALUES list."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def any_contains(text: str, phrases) -> str:
    """SQL: does the text contain any of the phrases?"""
    quoted = ["contains({}, '{}')".format(text, p.replace("'", "''")) for p in phrases]
    return "(" + " OR ".join(quoted) + ")"
