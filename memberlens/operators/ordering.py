"""Numbers and running totals in a total order, without a task that sees the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.sources.tables import stored

#: monotonically_increasing_id keeps the partition in the bits above these and the place in the partition below.
PLACE_BITS = 33

#: Rows whose running totals one task forms.
BLOCK = 65_536


def in_ranges(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """The stored rows with ``part``, ``place``: ranges of the order, and the place of each row in its range (from 0).

    The order must be total up to equal rows, or the places of equal rows are any.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(ranged.select(*df.columns, F.shiftright("place", PLACE_BITS).cast("int").alias("part"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("place")), name)


def earlier(totals: DataFrame, by: str, values: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """The sums of ``values`` over all earlier rows of ``totals`` (a row per range or block), as before_<value>."""
    before = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, by, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values])


def numbered_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str, number: str = "number") -> DataFrame:
    """Rows with their number in the order of their group, from 1. A group may span any number of ranges."""
    keys = list(groups)
    rows = in_ranges(df, [*keys, *order], name)
    parts = rows.groupBy("part", *keys).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    named = starts.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_{k}") for k in keys], "_start")
    same = rows["part"] == named["_part"]
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"_{k}"])
    return rows.join(named, same).select(*[rows[c] for c in df.columns], (rows["place"] + F.col("_start")).alias(number))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, number: str = "number") -> DataFrame:
    """Rows with their number in the order, from 0. Offsets are a row per range and are broadcast."""
    rows = in_ranges(df, order, name)
    offsets = earlier(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", ["n"])
    return rows.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("before_n") + F.col("place")).alias(number))


def prefix_sums(df: DataFrame, number: str, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Running totals (sum_<value>, current row included) by a dense ``number``: in blocks, with the totals of earlier ones.

    There is a row per block, and the blocks' own totals are formed in the same way while they are many.
    """
    cut = df.withColumn("block", F.floor(F.col(number) / F.lit(block)).cast("long"))
    inside = Window.partitionBy("block").orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = stored(cut.groupBy("block").agg(*[F.sum(v).alias(v) for v in values]), "blocks")
    if totals.count() > block:
        sums = prefix_sums(totals.withColumnRenamed("block", "cut"), "cut", values, block)
        offsets = sums.select(F.col("cut").alias("block"), *[(F.col(f"sum_{v}") - F.col(v)).alias(f"before_{v}") for v in values])
    else:
        offsets = earlier(totals, "block", values)
    return cut.join(offsets, "block").select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"before_{v}")).alias(f"sum_{v}") for v in values])
