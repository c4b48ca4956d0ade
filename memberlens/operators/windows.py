"""Ordered windows per person, and running totals over a whole table without a single-task sort.

The per-person forms expect one row per person and day or month, which bounds the group by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from memberlens.functions.expr import as_col, day_number, either, flag
from memberlens.operators.ordering import numbered_in_groups


WIDTH = 256  # range totals that are added up in one task; more of them form a tree


def timeline(key: str = "member_id", order: str = "event_date") -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def look_ahead(value: Column | str, n: int, mode: str = "days", key: str = "member_id",
               date: str = "event_date") -> Column:
    """Largest value over what follows: the next ``n`` days (``days``) or the next ``n`` rows (``rows``).

    The current row is excluded. ``days`` is what a name such as "30 day label" says; ``rows`` counts days that
    have events. NULL when nothing follows.
    """
    v = as_col(value)
    if mode == "days":
        return F.max(v).over(W.partitionBy(key).orderBy(day_number(date)).rangeBetween(1, n))
    return F.max(v).over(timeline(key, date).rowsBetween(1, n))


def trailing(n: int, mode: str = "days", include_current: bool = False, key: str = "member_id",
             date: str = "event_date") -> WindowSpec:
    """The ``n`` preceding days or rows, with or without the current one."""
    last = 0 if include_current else -1
    if mode == "days":
        return W.partitionBy(key).orderBy(day_number(date)).rangeBetween(-n, last)
    return timeline(key, date).rowsBetween(-n, last)


def delta_to_mean(value: str, window: WindowSpec) -> Column:
    return F.col(value) - F.avg(value).over(window)


def days_since_last(value: str, key: str = "member_id", date: str = "event_date") -> Column:
    """Days since the previous row where ``value`` was present; NULL when there was none."""
    before = timeline(key, date).rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(value).isNotNull(), F.col(date)), ignorenulls=True).over(before)
    return F.datediff(F.col(date), seen)


def newly_positive(value: str, n: int, key: str = "member_id", date: str = "event_date") -> Column:
    """1 when the value is above 0 now and was 0 (or before the first row) ``n`` rows ago."""
    return flag((F.col(value) > 0) & (F.lag(value, n, 0).over(timeline(key, date)) == 0))


def turned(value: str, before: int, now: int, key: str = "member_id", date: str = "month") -> Column:
    """1 on the row where a state changes from ``before`` to ``now``."""
    return flag((F.lag(value, 1).over(timeline(key, date)) == before) & (F.col(value) == now))


def change(value: str, key: str = "member_id", date: str = "month") -> Column:
    return F.col(value) - F.lag(value, 1).over(timeline(key, date))


def with_labels(days: DataFrame, horizons: Iterable[int], ed: str = "any_ed_on_date", ip: str = "any_ip_on_date",
                mode: str = "days", key: str = "member_id", date: str = "event_date") -> DataFrame:
    """Add look-ahead labels for both admission kinds, and for either, per horizon."""
    ahead = list(horizons)
    seen = days.select("*", *[look_ahead(c, n, mode, key, date).alias(f"y_{k}_{n}d") for n in ahead for k, c in (("ed", ed), ("ip", ip))])
    return seen.select("*", *[either(f"y_ed_{n}d", f"y_ip_{n}d").alias(f"y_any_{n}d") for n in ahead])


def with_group_means(df: DataFrame, value: str, groupings: dict[str, Sequence[str]]) -> DataFrame:
    """Attach the mean of ``value`` per grouping to every row.

    A window over a grouping with few groups would put a large share of the rows into one task; an aggregate has
    partial results and its small output joins back.
    """
    out = df
    for name, keys in groupings.items():
        means = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg(value).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = out.join(means, on, "left").drop(*[f"_{k}" for k in keys])
    return out


def range_buckets(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Cut points that split the ordered column into shares of similar size, as many as a shuffle has partitions."""
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * buckets).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def running_totals(df: DataFrame, order: str, values: Sequence[str], descending: bool = False,
                   buckets: int | None = None, prefix: str = "cum_", by: Sequence[str] = ()) -> DataFrame:
    """Running totals over the whole table (or per ``by`` group), ordered by a column that is unique in it.

    Rows are split into ranges of the ordering column; the totals of earlier ranges (one row per range) are added to
    a running total inside each range. No task sees the whole table.
    """
    groups = list(by)
    cuts = range_buckets(df, order, buckets)
    if not cuts:
        bucketed = df.withColumn("_bucket", F.lit(0.0))
    else:
        cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_bucket",
                            handleInvalid="keep")
        bucketed = cutter.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order")
    totals = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    offsets = range_offsets(totals, "_bucket", values, len(cuts) + 1, descending, groups)
    if not groups:
        offsets = F.broadcast(offsets)  # one row per bucket
    by_value = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*groups, "_bucket").orderBy(by_value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        bucketed.join(offsets, [*groups, "_bucket"])
        .select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"_before_{v}")).alias(prefix + v) for v in values])
    )


def range_offsets(totals: DataFrame, bucket: str, values: Sequence[str], ranges: int, descending: bool = False,
                  by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """The sums of ``values`` over all earlier ranges, as _before_<value>. ``totals`` has a row per range (and ``by`` group).

    More than ``width`` ranges are put together by ``width`` to ranges of ranges, whose own offsets come first; no task adds up
    more than ``width`` totals of a group.
    """
    groups = list(by)
    order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    if ranges <= width:
        earlier = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return totals.select(*groups, bucket, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values])
    upper = f"{bucket}_"
    cut = totals.withColumn(upper, F.floor(F.col(bucket) / F.lit(width)).cast("double"))
    above = range_offsets(cut.groupBy(*groups, upper).agg(*[F.sum(v).alias(v) for v in values]), upper, values, -(-ranges // width), descending, groups, width)
    inside = W.partitionBy(*groups, upper).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = cut.select(*groups, upper, bucket, *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    return own.join(above, [*groups, upper]).select(*groups, bucket, *[(F.col(f"_in_{v}") + F.col(f"_before_{v}")).alias(f"_before_{v}") for v in values])


def ranked_in_groups(df: DataFrame, groups: Sequence[str], value: str, ties: Sequence[str], rank: str) -> DataFrame:
    """Row numbers from the largest ``value`` down, for few large groups.

    Rows lie in ranges of (group, value, ties), so neither a group nor the rows of one value have to fit a task.
    """
    numbers = numbered_in_groups(df, groups, [F.desc(value), *ties], "ranked", rank)
    return numbers.withColumn(rank, F.col(rank).cast("int"))


def cumulative_share(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Distinct values with the share of rows at or below each (the cumulative distribution)."""
    counts = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return (
        running_totals(counts, order, ["n"], buckets=buckets)
        .select(order, "n", (F.col("cum_n") / total.scalar()).alias("cume_dist"))
    )


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows per group. Spark keeps only ``k`` candidates per input partition before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
