"""Point-in-time windows over person-level facts.

Every kernel first reduces facts to one row per person and day (or month), so a person's group is bounded by the
calendar and not by the number of facts. After that one shuffle by person serves every window and measure. Pairs of
anchors and facts are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date as Date
from datetime import timedelta
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memberlens.functions.expr import as_col, available_from, day_number, month_number


@dataclass(frozen=True)
class Measure:
    """What to take from the facts.

    ``total`` adds amounts as decimals with nine places and returns such a decimal, ``whole`` adds whole numbers;
    ``count`` counts rows where ``value`` is true, ``days`` counts distinct days with such a row. A sum that does not fit
    is an error, never a wrong value.
    """

    name: str
    value: Column
    kind: str = "total"


#: Amounts as they are declared, and their sums.
AMOUNT = "decimal(31,9)"
AMOUNT_SUM = "decimal(38,9)"
AMOUNT_TOTAL = "decimal(37,9)"


@dataclass(frozen=True)
class DaySpan:
    """Facts dated from ``anchor - oldest`` to ``anchor - newest`` days, both included."""

    suffix: str
    oldest: int
    newest: int = 1


@dataclass(frozen=True)
class DayBlock:
    """Measures that share their spans and their lag: what one lookback asks of the facts."""

    measures: Sequence[Measure]
    spans: Sequence[DaySpan]
    lag_months: int = 0


@dataclass(frozen=True)
class MonthMeasure:
    """One measure seen through several month windows.

    ``windows`` maps an output name to ``(first, last)``: months ``m + first`` to ``m + last`` around the spine month
    ``m``. ``any`` gives 0/1, ``count`` the number of rows, ``days`` the number of distinct dates, ``total`` a sum of
    decimal amounts and ``whole`` one of whole numbers.
    """

    windows: dict[str, tuple[int, int]]
    value: Column
    kind: str = "any"


def member_days(events: DataFrame, key: str = "member_id", date: str = "event_date") -> DataFrame:
    """Distinct (person, day) with at least one event."""
    return events.select(key, date).where(F.col(date).isNotNull()).distinct()


def _daily(measure: Measure | MonthMeasure) -> Column:
    """The measure within one day (or, for measures that add up, within one month)."""
    if measure.kind == "total":
        return F.sum(measure.value.cast(AMOUNT)).cast(AMOUNT_SUM)
    if measure.kind == "whole":
        return F.sum(measure.value.cast("bigint"))
    if measure.kind == "count":
        return F.count_if(measure.value)
    if measure.kind in ("days", "any"):
        return F.max(F.when(measure.value, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    raise ValueError(f"unknown measure kind {measure.kind!r}")


def day_lookback(anchors: DataFrame | None, facts: DataFrame, measures: Sequence[Measure], spans: Sequence[DaySpan],
                 key: str = "member_id", date: str = "event_date", fact_date: str | None = None,
                 lag_months: int = 0, lag_days: int = 0) -> DataFrame:
    """Sums, counts and distinct-day counts over day windows that end before each anchor day.

    ``anchors`` holds distinct (person, day); without it every day with a fact is an anchor, and the facts are read once for
    both. A fact counts for an anchor when it lies in the span and was already available: ``fact <= add_months(anchor,
    -lag_months)`` and ``fact <= anchor - lag_days``. Anchors without facts get zeros.

    Facts become running totals per person, and a window is the difference of the totals at its two edges. An edge of fixed
    distance to the anchor is read off the totals by day; the last day that a lag in months lets through has no fixed
    distance, so a second total adds each fact on the day it becomes available. A person-day is there once, or twice with such
    a lag, whatever the number of windows, and a window costs one step a row whatever its length.
    """
    source = fact_date or date
    by_day = (
        facts.where(F.col(key).isNotNull() & F.col(source).isNotNull())
        .groupBy(F.col(key), F.col(source).alias("_fact_day"))
        .agg(*[_daily(m).alias(m.name) for m in measures])
        # an ignored NULL in a sum must not blank the running total
        .select(key, "_fact_day", *[F.coalesce(F.col(m.name), F.lit(0)).alias(m.name) for m in measures])
    )

    def row(day: Column, anchor: bool, filled: str) -> Column:
        nothing = {m.name: F.when(F.lit(False), F.col(m.name)) for m in measures}
        cells = [(F.col(m.name) if kind == filled else nothing[m.name]).alias(f"_{kind}_{m.name}") for kind in ("own", "known") for m in measures]
        return F.struct(day_number(day).alias("_day"), F.lit(anchor).alias("_anchor"), *cells)

    rows = [row(F.col("_fact_day"), anchors is None, "own")]
    if lag_months:
        rows.append(row(available_from("_fact_day", lag_months), False, "known"))
    seen = by_day.select(F.col(key), F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")
    if anchors is not None:
        marks = anchors.select(F.col(key), day_number(date).alias("_day"), F.lit(True).alias("_anchor"))
        seen = marks.unionByName(seen, allowMissingColumns=True)

    order = W.partitionBy(key).orderBy("_day")
    edges = sorted({s.oldest + 1 for s in spans} | {max(s.newest, lag_days) for s in spans})

    def total(m: Measure, kind: str, until: int) -> Column:
        so_far = F.coalesce(F.sum(f"_{kind}_{m.name}").over(order.rangeBetween(W.unboundedPreceding, -until)), F.lit(0))
        return so_far.cast(AMOUNT_TOTAL) if m.kind == "total" else so_far  # a digit is free for the difference

    totals = {f"_until{e}_{m.name}": total(m, "own", e) for m in measures for e in edges}
    if lag_months:
        totals |= {f"_known_until_{m.name}": total(m, "known", 0) for m in measures}
    summed = seen.select(key, "_day", "_anchor", *[t.alias(n) for n, t in totals.items()]).where("_anchor")
    day = F.col("_day")
    known = day_number(F.add_months(F.date_from_unix_date("_day"), -lag_months)) if lag_months else None
    out = []
    for span in spans:
        end = max(span.newest, lag_days)
        for m in measures:
            high, low = F.col(f"_until{end}_{m.name}"), F.col(f"_until{span.oldest + 1}_{m.name}")
            if lag_months:
                high = F.when(known < day - end, F.col(f"_known_until_{m.name}")).otherwise(high)
            within = high - low
            if lag_months:
                within = F.when(known >= day - span.oldest, within)
            out.append(_whole(within, m).alias(f"{m.name}_{span.suffix}" if span.suffix else m.name))
    return summed.select(F.col(key), F.date_from_unix_date("_day").alias(date), *out)


@cache
def lag_distances(lag_months: int) -> tuple[int, ...]:
    """All numbers of days that a day can be away from the same day ``lag_months`` months before, shortest first."""
    def earlier(day: Date) -> Date:
        month = day.year * 12 + day.month - 1 - lag_months
        length = (Date((month + 1) // 12, (month + 1) % 12 + 1, 1) - Date(month // 12, month % 12 + 1, 1)).days
        return Date(month // 12, month % 12 + 1, min(day.day, length))

    # years with every place of leap years among them: eight years without one, and four in which one is the first to the last
    days = (Date(year, 1, 1) + timedelta(n) for year in (*range(1892, 1913), *range(1992, 2013)) for n in range(366))
    return tuple(sorted({(day - earlier(day)).days for day in days}))


def day_lookbacks(log: DataFrame, blocks: Sequence[DayBlock], carried: Mapping[str, Column] = {}, key: str = "member_id",
                  date: str = "event_date") -> DataFrame:
    """Several lookbacks over one log in one reduction and one sorted pass; every day of the log is an anchor.

    The columns are those of ``day_lookback`` without anchors for each block, and ``carried``, which are aggregates of the day itself.
    Names of measures differ between blocks. A person-day is there once: the last day that a lag in months lets through is one of a few
    distances away (four at most), so its total is picked from the totals at these distances and facts need no second row.
    """
    dated = log.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    measures = [m for b in blocks for m in b.measures]
    by_day = dated.groupBy(key, date).agg(*[_daily(m).alias(m.name) for m in measures], *[c.alias(n) for n, c in carried.items()])
    # an ignored NULL in a sum must not blank the running total
    days = by_day.withColumns({m.name: F.coalesce(F.col(m.name), F.lit(0)) for m in measures})

    order = W.partitionBy(key).orderBy(day_number(date))
    totals: dict[str, Column] = {}

    def until(m: Measure, edge: int) -> Column:
        name = f"_until{edge}_{m.name}"
        if name not in totals:
            so_far = F.coalesce(F.sum(m.name).over(order.rangeBetween(W.unboundedPreceding, -edge)), F.lit(0))
            totals[name] = so_far.cast(AMOUNT_TOTAL) if m.kind == "total" else so_far  # a digit is free for the difference
        return F.col(name)

    out = []
    for block in blocks:
        lag = block.lag_months
        away = F.datediff(F.col(date), F.add_months(F.col(date), -lag))
        for span in block.spans:
            ends = sorted({max(span.newest, n) for n in (lag_distances(lag) if lag else ())}) or [span.newest]
            ends = [n for n in ends if n <= span.oldest]
            for m in block.measures:
                within = F.lit(0)
                if ends:
                    high = until(m, ends[-1])
                    for n in ends[-2::-1]:
                        high = F.when(away <= n, until(m, n)).otherwise(high)
                    within = high - until(m, span.oldest + 1)
                    if lag and lag_distances(lag)[-1] > span.oldest:
                        within = F.when(away <= span.oldest, within)
                out.append(_whole(within.cast(AMOUNT_TOTAL) if m.kind == "total" else within.cast("bigint"), m).alias(
                    f"{m.name}_{span.suffix}" if span.suffix else m.name))
    summed = days.select(key, date, *carried, *[t.alias(n) for n, t in totals.items()])
    return summed.select(key, date, *out, *carried)


def _whole(value: Column, measure: Measure | MonthMeasure) -> Column:
    filled = F.coalesce(value, F.lit(0))
    return filled.cast(AMOUNT_SUM) if measure.kind == "total" else filled


# The two forms below give the same windows by other plans; tests compare them.

def _framed(marks: DataFrame, by_day: DataFrame, outputs: Sequence[tuple[str, Measure, int]], spans: Sequence[DaySpan],
            key: str, lag_months: int, lag_days: int) -> DataFrame:
    """Windows of fixed distance to the anchor as range frames."""
    days = by_day.select(key, day_number("_fact_day").alias("_day"), *dict.fromkeys(m.name for _, m, _ in outputs))
    order = W.partitionBy(key).orderBy("_day")
    return marks.unionByName(days, allowMissingColumns=True).select(key, "_day", "_anchor", *[
        F.sum(m.name).over(order.rangeBetween(-spans[i].oldest, -max(spans[i].newest, lag_days))).alias(n)
        for n, m, i in outputs])


def _swept(marks: DataFrame, by_day: DataFrame, outputs: Sequence[tuple[str, Measure, int]], spans: Sequence[DaySpan],
           key: str, lag_months: int, lag_days: int) -> DataFrame:
    """Running totals of what becomes visible and what drops out.

    A fact dated ``e`` is seen by the anchors from ``max(e + newest, available)`` to ``e + oldest``. It adds its value
    on the first of these days and takes it back on the day after the last, so a running total per person holds the
    answer at each anchor. The cost is linear in facts and anchors. Changes on one day share a row.
    """
    fact = day_number("_fact_day")
    ready = day_number(available_from("_fact_day", lag_months)) if lag_months else fact
    bounds, changes = {}, []
    for i, span in enumerate(spans):
        start, stop = F.greatest(fact + max(span.newest, lag_days), ready), fact + span.oldest + 1
        bounds |= {f"_start{i}": F.when(start < stop, start), f"_stop{i}": F.when(start < stop, stop)}
        changes += [F.col(f"_start{i}"), F.col(f"_stop{i}")]
    moved = by_day.withColumns(bounds).withColumn("_day", F.explode(F.array_distinct(F.array_compact(F.array(*changes)))))
    deltas = moved.select(F.col(key), "_day", F.lit(0).alias("_anchor"), *[
        F.when(F.col("_day") == F.col(f"_start{i}"), F.col(m.name)).when(F.col("_day") == F.col(f"_stop{i}"), -F.col(m.name)).alias(n)
        for n, m, i in outputs])
    # changes of a day come before that day's anchor
    running = W.partitionBy(key).orderBy("_day", "_anchor").rowsBetween(W.unboundedPreceding, W.currentRow)
    return marks.unionByName(deltas, allowMissingColumns=True).select(
        key, "_day", "_anchor", *[F.sum(n).over(running).alias(n) for n, _, _ in outputs])


def possession_block(classes: Mapping[str, Column], days: Sequence[int], supply: str = "days_supply", lag_months: int = 0) -> DayBlock:
    """Days of supply filled, per drug class and window."""
    measures = [Measure(f"mpr_{name}", F.when(hit & (F.col(supply) > 0), F.col(supply)).otherwise(0), "whole") for name, hit in classes.items()]
    return DayBlock(measures, [DaySpan(f"{n}d", n) for n in days], lag_months)


def possession_shares(classes: Mapping[str, Column], days: Sequence[int]) -> dict[str, Column]:
    """Days of supply divided by the length of the window."""
    return {f"mpr_{name}_{n}d": F.col(f"mpr_{name}_{n}d") / F.lit(float(n)) for n in days for name in classes}


def possession_ratio(anchors: DataFrame | None, fills: DataFrame, classes: dict[str, Column], days: Sequence[int],
                     supply: str = "days_supply", key: str = "member_id", date: str = "event_date",
                     fact_date: str = "filled_date", lag_months: int = 0, lag_days: int = 0) -> DataFrame:
    """Days of supply filled in the window divided by its length, per drug class and window."""
    block = possession_block(classes, days, supply, lag_months)
    out = day_lookback(anchors, fills, block.measures, block.spans, key, date, fact_date, lag_months, lag_days)
    return out.select(key, date, *[c.alias(n) for n, c in possession_shares(classes, days).items()])


def merged_counts(left: Column | str, *others: Column | str) -> Column:
    """Sum of counts from lagged and unlagged sources, a missing source counting 0."""
    total = F.coalesce(as_col(left), F.lit(0))
    for other in others:
        total = total + F.coalesce(as_col(other), F.lit(0))
    return total


def month_windows(spine: DataFrame, sources: Sequence[tuple[DataFrame, str, Sequence[MonthMeasure]]],
                  key: str = "member_id", month: str = "month", place: Callable[[DataFrame], DataFrame] = lambda months: months) -> DataFrame:
    """All month-window measures of all sources in one pass over a distinct (person, month) spine.

    Each source is (facts, date column, measures). Facts are reduced to (person, month); months are disjoint, so
    counts of distinct dates add up over them. Sources and spine are then unioned, and every measure is a range frame
    over the month number of one sorted window. ``place`` may lay the reduced facts where the rows of the spine lie.
    """
    parts = [
        spine.select(F.col(key), month_number(month).alias("_m"), F.lit(1).alias("_spine"), F.col(month).alias("_month"))
    ]
    bases: list[tuple[str, MonthMeasure]] = []
    for facts, date, measures in sources:
        own = [(f"_v{len(bases) + i}", m) for i, m in enumerate(measures)]
        bases += own
        dated = facts.where(F.col(date).isNotNull())
        if any(m.kind == "days" for m in measures):
            # one row per day first: distinct dates become a plain sum
            per_day = dated.groupBy(F.col(key), F.to_date(date).alias("_d")).agg(*[_daily(m).alias(b) for b, m in own])
            monthly = per_day.groupBy(F.col(key), month_number("_d").alias("_m")).agg(
                *[(F.max(b) if m.kind == "any" else F.sum(b)).alias(b) for b, m in own]
            )
        else:
            monthly = dated.groupBy(F.col(key), month_number(date).alias("_m")).agg(*[_daily(m).alias(b) for b, m in own])
        parts.append(place(monthly))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)

    outputs = []
    for base, measure in bases:
        for name, (first, last) in measure.windows.items():
            frame = W.partitionBy(key).orderBy("_m").rangeBetween(first, last)
            if measure.kind == "any":
                out = F.coalesce(F.max(base).over(frame), F.lit(0)).cast("int")
            else:
                out = _whole(F.sum(base).over(frame), measure)
                out = out if measure.kind == "total" else out.cast("bigint")
            outputs.append((name, out))
    seen = union.select(key, "_month", "_spine", *[out.alias(name) for name, out in outputs])
    return seen.where(F.col("_spine") == 1).select(key, F.col("_month").alias(month), *[name for name, _ in outputs])


def first_followup(anchors: DataFrame, followups: DataFrame, within_days: int, key: str = "member_id",
                   date: str = "event_date", result: str = "first_followup") -> DataFrame:
    """Earliest follow-up day from the anchor day to ``within_days`` later, NULL when there is none."""
    marks = member_days(anchors, key, date).select(key, day_number(date).alias("_d"), F.lit(1).alias("_anchor"))
    hits = member_days(followups, key, date).select(
        key, day_number(date).alias("_d"), day_number(date).alias("_hit")
    )
    frame = W.partitionBy(key).orderBy("_d").rangeBetween(0, within_days)
    out = marks.unionByName(hits, allowMissingColumns=True).select(
        key, "_d", "_anchor", F.min("_hit").over(frame).alias("_first")
    )
    return out.where(F.col("_anchor") == 1).select(
        key, F.date_from_unix_date("_d").alias(date), F.date_from_unix_date("_first").alias(result)
    )
