"""Orders over whole tables, from the library, and a setting for rows that hold whole blocks of data."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from memberlens.operators.ordering import BLOCK, earlier, in_ranges, numbered, prefix_sums

__all__ = ["BLOCK", "batch_rows", "earlier", "in_ranges", "numbered", "prefix_sums"]


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Rows in an Arrow batch while an action runs; for rows that hold whole blocks of data."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
