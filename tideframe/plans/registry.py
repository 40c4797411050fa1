"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int) -> Column:
    """``c`` to so many digits as the SQL rounds a double: scaled, rounded half away from zero, scaled back.

    ``F.round`` rounds the shortest decimal of a double instead, which parts from it at ties and at large numbers.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled = F.round(c * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), c).otherwise(scaled)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
