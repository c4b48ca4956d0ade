"""Checks of published tables. Each returns a DataFrame; the suite turns them into one status table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from memberlens.operators.tabular import duplicate_keys
from memberlens.sources.tables import stored


def long_counts(df: DataFrame, counts: Mapping[str, Column], name: str = "check", value: str = "n") -> DataFrame:
    """Several conditional counts from one scan, one row each."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).unpivot([], list(counts), name, value)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_counts(df, {c: F.col(c).isNull() for c in columns}, "column_name", "null_count")


def invalid_values(df: DataFrame, columns: Sequence[str], allowed: Iterable = (0, 1)) -> DataFrame:
    """Values outside the allowed set; NULL is not one of them."""
    listed = list(allowed)
    return long_counts(df, {c: ~F.col(c).isin(listed) for c in columns}, "column_name", "invalid_count")


def rule_breaches(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule (the rule is the condition of a bad row)."""
    return long_counts(df, rules, "rule", "invalid_record_count")


def one_hot_breaches(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose indicator columns do not add up to one, per group."""
    def total(columns):
        return reduce(lambda a, b: a + b, [F.col(c) for c in columns])

    return rule_breaches(df, {name: total(cols) != 1 for name, cols in groups.items()})


def split_leaks(df: DataFrame, key: str = "member_id", split: str = "dataset_split") -> DataFrame:
    """Members that occur in more than one split."""
    pairs = df.select(key, split).where(F.col(split).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("splits")).where(F.col("splits") > 1)


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample deviation per column and whether it shows no variation."""
    wide = df.agg(*[F.stddev_samp(c).alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "column_name", "deviation")
    return long.withColumn("is_constant", F.coalesce(F.col("deviation") == 0, F.lit(True)))


def latency(df: DataFrame, date: str, asof: str) -> DataFrame:
    """Smallest, mean and largest age in days, and how many dates lie after the as-of day."""
    day = F.lit(asof).cast("date")
    age = F.datediff(day, F.col(date))
    return df.agg(F.min(age).alias("min_days_latency"), F.avg(age).alias("avg_days_latency"), F.max(age).alias("max_days_latency"),
                  F.count_if(F.col(date) > day).alias("future_event_dates"))


def distribution(df: DataFrame, by: Sequence[str], date: str, key: str = "member_id") -> DataFrame:
    """Rows, distinct members and date range per group."""
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("unique_members"),
                               F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def monthly_by_source(events: DataFrame, source: Column, counts: Mapping[str, Column], date: str = "event_date",
                      key: str = "member_id") -> DataFrame:
    """Per year, month and source: conditional counts and distinct members."""
    return events.withColumn("source_category", source).where(F.col("source_category").isNotNull()).groupBy(
        F.year(date).alias("event_year"), F.month(date).alias("event_month"), "source_category",
    ).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.count_distinct(key).alias("unique_individuals"))


def positive_days(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("member_id", "event_date")) -> DataFrame:
    """Distinct member-days with each label set, and all distinct member-days.

    Days are reduced to one row first, which turns the distinct counts into sums.
    """
    per_day = df.groupBy(*keys).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in labels])
    return per_day.agg(*[F.sum(c).alias(f"positive_{c}_days") for c in labels], F.count("*").alias("total_unique_days"))


def control_flags(sources: Mapping[str, tuple[DataFrame, Column]], key: str = "member_id") -> DataFrame:
    """Distinct members per named condition, one row each."""
    parts = [
        df.agg(F.count_distinct(F.when(cond, F.col(key))).alias("value")).select(F.lit(name).alias("flag"), "value")
        for name, (df, cond) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Check:
    """A named frame of findings. Informational frames always pass; ``bad`` selects the findings that count."""

    name: str
    findings: DataFrame
    bad: Column | None = None
    informational: bool = False


def _status(informational: Column) -> Column:
    return F.when(informational, "INFO").when(F.col("n_findings") == 0, "OK").otherwise("ISSUES FOUND")


def run_suite(checks: Sequence[Check]) -> DataFrame:
    """One row per check: its status and the number of findings. Only counts leave the executors."""
    rows = []
    for check in checks:
        found = check.findings if check.bad is None else check.findings.where(check.bad)
        n = found.agg(F.count("*").alias("n_findings"))
        rows.append(n.select(F.lit(check.name).alias("check"), _status(F.lit(check.informational)).alias("status"), "n_findings"))
    return reduce(DataFrame.unionByName, rows)


def row_suite(df: DataFrame, bad_rows: Mapping[str, Column]) -> DataFrame:
    """All checks that look at one row at a time, from a single scan."""
    counts = long_counts(df, bad_rows, "check", "n_findings")
    return counts.select("check", _status(F.lit(False)).alias("status"), "n_findings")


def bad_days(labels: Sequence[str], keys: Sequence[str] = ("member_id", "event_date"), asof: str | None = None) -> dict[str, Column]:
    """The standard conditions of a bad row of a member-day table."""
    def any_of(conditions):
        return reduce(lambda a, b: a | b, conditions)

    bad = {
        "null_keys": any_of(F.col(k).isNull() for k in keys),
        "null_labels": any_of(F.col(y).isNull() for y in labels),
        "invalid_labels": any_of(~F.coalesce(F.col(y), F.lit(0)).isin(0, 1) for y in labels),
    }
    return bad | ({"future_dates": F.col(keys[-1]) > F.lit(asof).cast("date")} if asof else {})


def member_day_suite(days: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("member_id", "event_date"),
                     asof: str | None = None) -> DataFrame:
    """The standard checks of a member-day table: one scan for the row checks and one grouping for repeated keys."""
    return row_suite(days, bad_days(labels, keys, asof)).unionByName(run_suite([Check("duplicate_keys", duplicate_keys(days, keys))]))


def checked_stage(df: DataFrame, name: str, bad_rows: Mapping[str, Column], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Write a stage and gather its checks while it is written: (the stage, one row per check).

    Counts are observed on the rows on their way to the files, so the checks need no scan and no job of their own. With ``keys``
    the second row of every repeated key is observed too, which counts the keys that occur more than once. Only counts reach
    the driver.
    """
    seen, counted = Observation(f"{name}-{uuid.uuid4().hex}"), dict(bad_rows)
    rows = df
    if keys:
        rows = df.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
        counted["duplicate_keys"] = F.col("_copy") == 2
    watched = rows.observe(seen, *[F.count_if(c).alias(n) for n, c in counted.items()])
    stage = stored(watched.drop("_copy"), name)
    found = df.sparkSession.createDataFrame([(n, seen.get[n]) for n in counted], "check string, n_findings long")
    return stage, found.select("check", _status(F.lit(False)).alias("status"), "n_findings")


def checked_member_days(days: DataFrame, name: str, labels: Sequence[str], keys: Sequence[str] = ("member_id", "event_date"),
                        asof: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A member-day table as a stage, with its standard checks gathered on the way."""
    return checked_stage(days, name, bad_days(labels, keys, asof), keys)
