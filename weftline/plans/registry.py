"""A place where query modules register what the driver may run."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the DuckDB SQL that must give the same rows, where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = _shipping(f)
            if sql:
                self.sql[key] = sql
            return f

        return add


def _shipping(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
