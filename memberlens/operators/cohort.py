"""Cohort extraction and member-level splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.expr import as_col, clean, month_start, priority_label


def enrolment_status() -> Column:
    """Suspended members count as disenrolled, then engaged, batched, unserved and not selected."""
    return priority_label([
        (F.upper("current_status").like("%SUSPENDED%"), "DISENROLLED"),
        (F.col("has_ever_been_engaged"), "ENGAGED"),
        (F.col("is_batched"), "BATCHED"),
        (~F.col("is_batched") & F.col("market").isNull(), "UNSERVED GEO"),
        (~F.col("is_batched"), "NOT SELECTED"),
    ])


def restricted(source: DataFrame, members: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Chosen columns of a source for the cohort only."""
    picked = source if where is None else source.where(where)
    return picked.select("member_id", *columns).join(members.select("member_id").distinct(), "member_id", "left_semi")


def control_counts(tables: Mapping[str, DataFrame], key: str = "member_id") -> DataFrame:
    """Rows and distinct members per table, one row each."""
    counts = [
        df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("unique_members"))
        .select(F.lit(name).alias("table_name"), "row_count", "unique_members")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def channel_split(log: DataFrame, party: Column, directions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of the wanted party with the channel their direction belongs to; other directions are dropped."""
    way = F.lower("direction")
    channel = priority_label([(way.isin(list(words)), name) for name, words in directions.items()])
    return log.where(party).withColumn("channel", channel).where(F.col("channel").isNotNull())


def member_bucket(key: Column | str = "member_id", salt: str = "", buckets: int = 100) -> Column:
    """Stable bucket of a member, the same on every run and engine: leading 32 bits of md5, modulo ``buckets``."""
    digest = F.md5(F.concat(as_col(key).cast("string"), F.lit(salt)) if salt else as_col(key).cast("string"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def member_split(df: DataFrame, shares: Mapping[str, float], key: str = "member_id", seed: str = "",
                 column: str = "split") -> DataFrame:
    """Assign all rows of a member to one split in the given shares (which add up to 1)."""
    size = 2**32
    bucket, edge, rules = member_bucket(key, seed, size), 0.0, []
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        rules.append((bucket < round(edge * size), name))
    return df.withColumn(column, priority_label(rules, names[-1]) if rules else F.lit(names[-1]))


def labelled_split(df: DataFrame, target: str, test: float = 0.2, validation: float = 0.25, key: str = "member_id",
                   seed: str = "") -> DataFrame:
    """Train / val / test per member (validation is a share of what is not test); rows without a target are dropped."""
    rest = 1 - test
    shares = {"train": rest * (1 - validation), "val": rest * validation, "test": test}
    return member_split(df.where(F.col(target).isNotNull()), shares, key, seed)


def dataset_variants(df: DataFrame, variants: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Named subsets of one table; nothing is copied until one is written."""
    return {name: df.where(predicate) for name, predicate in variants.items()}


def unmatched_reasons(events: DataFrame, members: DataFrame, qualification: DataFrame,
                      excluded: Sequence[str]) -> DataFrame:
    """Why the members of unmatched events (market is NULL) failed to join, counted per reason."""
    lost = events.where(F.col("market").isNull() & F.col("member_id").isNotNull()).select("member_id").distinct()
    checked = (
        lost.join(members.select("member_id", F.lit(True).alias("_listed"), clean("coverage").alias("_coverage")), "member_id", "left")
        .join(qualification.select("member_id", F.col("is_qualified").alias("_qualified")), "member_id", "left")
    )
    reason = priority_label([
        (F.col("_listed").isNull(), "not in member list"),
        (F.col("_qualified") == 0, "not qualified"),
        (F.col("_qualified").isNull(), "no qualification entry"),
        (F.col("_coverage").isin(list(excluded)), "excluded coverage"),
    ], "other")
    return checked.groupBy(reason.alias("failure_reason")).agg(F.count_distinct("member_id").alias("unmatched_members"))


def reconcile_encounters(feeds: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """Distinct admissions with one flag per source that reported them.

    ``feeds`` has member_id, admit_date and source_type; ``sources`` maps an output flag to a source type.
    """
    return feeds.where(F.col("admit_date").isNotNull()).groupBy("member_id", "admit_date").agg(
        *[F.max(F.when(F.col("source_type") == kind, 1).otherwise(0)).alias(name) for name, kind in sources.items()]
    ).withColumn("month", month_start("admit_date"))


def encounter_months(reconciled: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Admissions per member-month, and how many of them each source confirms."""
    return reconciled.groupBy("member_id", "month").agg(
        F.count("*").alias("num_admissions"), *[F.sum(s).alias(f"count_{s}") for s in sources])
