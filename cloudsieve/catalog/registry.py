"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query '{name}' registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """Round a double to six places, the precision both engines are compared at."""
    e = F.col(c) if isinstance(c, str) else c
    out = F.round(e.cast("double"), 6)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])
