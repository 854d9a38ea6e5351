"""Named parquet tables of one data folder, and the registry of queries over them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``tables.part`` reads ``<folder>/part.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table of narrow rows whose every row becomes heavy work: dealt by key over the shuffle partitions."""
        table = getattr(self, name)
        return table.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that must give the same rows."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
