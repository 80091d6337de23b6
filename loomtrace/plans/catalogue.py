"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function as ``name``; ``sql`` is its DuckDB equivalent."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def uid_sql(x: str) -> str:
    """DuckDB's form of the base 36 digest: five parts of five digits each."""
    n = f"('0x' || md5({x}))::UHUGEINT"
    parts = [f"lower(to_base((({n} // {36 ** (5 * k)}::UHUGEINT) % {36**5}::UHUGEINT)::BIGINT, 36, 5))" for k in range(4, -1, -1)]
    return f"upper(ltrim({' || '.join(parts)}, '0'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
