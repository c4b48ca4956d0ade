"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be called heavy, at most; their table is what a join broadcasts.
HEAVY = 4_096


def heavy_and_light(keys: DataFrame, weight: str, most: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Split a stored table of distinct keys by the rows (``weight``) each stands for.

    A heavy key stands for more than one in ``most`` of all rows, so there are fewer than ``most`` of them however large the
    table is: they can be broadcast. A light key is a small part of one task.
    """
    total = keys.agg(F.coalesce(F.sum(F.col(weight).cast("decimal(38,0)")), F.lit(0))).first()[0]
    heavy = F.col(weight).cast("decimal(38,0)") * F.lit(most) > F.lit(total)
    return keys.where(heavy), keys.where(~heavy)


def semi_join(rows: DataFrame, keys: DataFrame, on: Sequence[str], weight: str, most: int = HEAVY) -> DataFrame:
    """The rows whose key is in ``keys`` (stored, one row a key). Both tables are read twice, so ``rows`` is better stored."""
    heavy, light = heavy_and_light(keys, weight, most)
    on = list(on)
    return rows.join(F.broadcast(heavy.select(on)), on, "left_semi").unionByName(rows.join(light.select(on), on, "left_semi"))


def lookup(rows: DataFrame, keys: DataFrame, on: Sequence[str], weight: str, most: int = HEAVY) -> DataFrame:
    """``rows`` with the columns of ``keys`` (stored, one row a key); rows without a key go. Both tables are read twice."""
    heavy, light = heavy_and_light(keys, weight, most)
    on = list(on)
    return rows.join(F.broadcast(heavy.drop(weight)), on).unionByName(rows.join(light.drop(weight), on))
