"""Reading the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, object]:
    """Empty QUERIES and ORACLES, and a decorator that registers a query under its name with its SQL."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query
