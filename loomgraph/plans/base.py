"""The registry of queries and what they share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its name, with the SQL that gives the same rows."""
        def keep(fn: Query) -> Query:
            self.queries[name or fn.__name__] = fn
            if sql:
                self.oracles[name or fn.__name__] = sql
            return fn
        return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def DOT(a: str, b: str) -> str:  # noqa: N802
    """DuckDB SQL of a dot product of two DOUBLE[]."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
