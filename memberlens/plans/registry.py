"""Named runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The parquet tables of one folder. ``stages`` holds feeds that were already written, by the name of their role."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}
        self.stages: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            if name not in self._open:
                self._open[name] = self.spark.read.parquet(self.path(name))
            return self._open[name]
        raise AttributeError(name)


def role(fn: Callable[[Tables], DataFrame]):
    """A feed that reads the stage of its name where there is one."""

    @functools.wraps(fn)
    def read(t: Tables) -> DataFrame:
        return t.stages[fn.__name__] if fn.__name__ in t.stages else fn(t)

    return read


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` is the equivalent SQL, if SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
