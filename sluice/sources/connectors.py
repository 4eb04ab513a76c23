"""Registry of sources and sinks by kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    def snapshot(self, table: str) -> DataFrame: ...


class Sink(Protocol):
    def apply(self, deletes: DataFrame, upserts: DataFrame, keys: list[str], batch: int | None = None): ...


SOURCES: dict[str, Callable[..., Source]] = {}
SINKS: dict[str, Callable[..., Sink]] = {}


def source(kind: str):
    return lambda make: SOURCES.setdefault(kind, make)


def sink(kind: str):
    return lambda make: SINKS.setdefault(kind, make)


@source("parquet")
class ParquetSource:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def snapshot(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")


@source("jdbc")
class JdbcSource:
    """Any database with a driver on the class path; split by a numeric key where bounds are given."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def snapshot(self, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1) -> DataFrame:
        r = self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options)
        if column and bounds:
            r = r.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
        return r.load()


@sink("table")
def _table(spark: SparkSession, path: str):
    from ..operators.table import VersionedTable

    return VersionedTable(spark, path)
