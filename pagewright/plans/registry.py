"""Registry of runnable queries and, where SQL can say the same, their ANSI-SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "url_queries",
    "detection_queries",
    "text_queries",
    "pagination_queries",
    "state_queries",
    "crawl_queries",
    "learning_queries",
    "job_queries",
    "event_queries",
    "attempt_queries",
]


class Tables:
    """Lazy access to the parquet tables of one data folder.

    Tables are read as their files are split. Where all of them are single small files, a session may set
    `spark.pagewright.partitions` to deal every table out anew, whatever its size.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.partitions = spark.conf.get("spark.pagewright.partitions", None)

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return table.repartition(int(self.partitions)) if self.partitions else table


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        _REGISTRY[name] = Query(name, run, sql)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"pagewright.plans.{module}")
    return dict(_REGISTRY)
