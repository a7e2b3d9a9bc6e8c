"""Registered queries: every operator applied to the shared tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table


class Tables:
    """Shared tables of one folder, read on attribute access."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    @property
    def tasks(self) -> int:
        """Partitions for costly row work on the small shared tables."""
        return self.spark.sparkContext.defaultParallelism

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
MODULES = ["windows", "quality", "state", "joins", "gates", "facets", "scalars", "records", "webpages", "reports", "provisional", "pagejobs"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an inventory id."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(lambda spark, root: fn(Tables(spark, root)), sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"gleanery.workload.{module}")
    return QUERIES
