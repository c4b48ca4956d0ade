"""The member-month table: eligibility, demographics, engagement, contacts and assembly."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.functions.expr import (
    at_least, band_flags, band_start, calendar_flags, flag, gender_flags, month_number, month_start, one_hot,
    prefix_flags, ratio, years_crossed,
)
from memberlens.operators import lookback as lb
from memberlens.operators import windows as wn

KEYS = ["member_id", "month"]


def dense_months(spans: DataFrame, first: str = "first_month", last: str = "last_month") -> DataFrame:
    """Every month of each member's span."""
    months = F.sequence(F.col(first), F.col(last), F.expr("interval 1 month"))
    return spans.select("member_id", F.explode(months).alias("month"))


def eligibility_spans(months: DataFrame, cutoff: str) -> DataFrame:
    """Enrolled, reinstated and disenrolled per member-month up to the cut-off month.

    An unknown enrolment counts as not enrolled. The last month of a member is a disenrolment when it lies before the
    cut-off.
    """
    limit = F.lit(cutoff).cast("date")
    enrolled = months.where(F.col("month") <= limit).withColumn(
        "is_enrolled", F.coalesce(F.col("is_continuously_enrolled"), F.lit(False)).cast("int")
    )
    last = F.max("month").over(W.partitionBy("member_id"))
    return enrolled.select(
        "member_id", "month", "month_end", "is_enrolled",
        wn.turned("is_enrolled", 0, 1).alias("is_reinstated"),
        F.when(F.col("is_enrolled") == 0, 1).when((F.col("month") == last) & (last < limit), 1).otherwise(0)
        .alias("is_disenrolled"),
    )


def demographics(members: DataFrame, asof: str) -> DataFrame:
    """Gender flags and five-year age bands at a fixed date, one row per member."""
    age = years_crossed("dob", F.lit(asof).cast("date"))
    return members.select(
        "member_id", *gender_flags("gender"), band_start(age, 5).alias("age_bucket"),
        *band_flags(age, 15, 100, 5, "is_age_"),
    )


def unified_months(spans: DataFrame, members: DataFrame, age_at: str = "2023-01-01") -> DataFrame:
    """Eligibility with calendar one-hots and demographics."""
    return spans.select("*", *calendar_flags("month")).join(demographics(members, age_at), "member_id", "left")


def product_and_market_flags(members: DataFrame, markets: Sequence[str] = codes.MARKETS,
                             prefixes: Mapping[str, str] = codes.PRODUCT_PREFIXES) -> DataFrame:
    return members.select(
        "member_id", *prefix_flags("coverage", prefixes), *one_hot("market", markets, "is_market_"),
    )


def engagement_months(spine: DataFrame, members: DataFrame) -> DataFrame:
    """Selected / engaged at all, and first selected / engaged in this month."""
    dates = members.select("member_id", "first_selected_date", "first_engaged_date")
    out = spine.select(*KEYS).join(dates, "member_id")
    picked = []
    for word in ("selected", "engaged"):
        first = F.col(f"first_{word}_date")
        picked += [flag(first.isNotNull()).alias(f"is_ever_{word}"),
                   flag(month_start(first) == F.col("month")).alias(f"is_{word}_month")]
    return out.select(*KEYS, *picked)


def contact_metrics(spine: DataFrame, contacts: DataFrame, tried_from: int = 2, succeeded_from: int = 2,
                    intense_from: int = 10, support_from: int = 5, weight: str | None = None,
                    place: Callable[[DataFrame], DataFrame] = lambda months: months) -> DataFrame:
    """Contact attempts of the month: counts, success rate and intensity flags.

    ``weight`` names the number of attempts that a row stands for, where contacts were added up before. ``tried_from`` and ``succeeded_from`` default to 2 because the published rule asks for more than one attempt.
    """
    own = contacts.where(F.col("contact_subject") == "individual")
    n = F.col(weight) if weight else F.lit(1)
    counts = lb.month_windows(spine, [(own, "contact_date", [
        lb.MonthMeasure({f"{status}_contact_attempts": (0, 0)}, F.when(F.col("status") == status, n).otherwise(0), "whole")
        for status in ("successful", "unsuccessful")
    ])], place=place)
    ok, total = F.col("successful_contact_attempts"), F.col("total_contact_attempts")
    return counts.withColumn("total_contact_attempts", ok + F.col("unsuccessful_contact_attempts")).select(
        "*",
        at_least(total, tried_from).alias("is_tried_contact_in_month"),
        at_least(ok, succeeded_from).alias("is_successful_contact_in_month"),
        F.coalesce(ratio(ok, total), F.lit(0.0)).alias("success_rate_this_month"),
        at_least(total, intense_from).alias("is_intense_attempt_in_month"),
        at_least(ok, support_from).alias("is_intense_support_in_month"),
    )


def contact_trend(members: DataFrame, contacts: DataFrame, asof_month: str) -> DataFrame:
    """Success rate of the as-of month against the three months ending with it: up, down or same."""
    m0 = F.lit(asof_month).cast("date")
    month = month_start("contact_date")
    ok, now = F.col("status") == "successful", month == m0
    recent = (month <= m0) & (month >= F.add_months(m0, -2))
    per_member = contacts.where(F.col("contact_subject") == "individual").groupBy("member_id").agg(
        F.max(flag(ok)).alias("has_ever_successful_contact"),
        F.max(flag(ok & now)).alias("has_successful_contact_this_month"),
        ratio(F.count_if(ok & now), F.count_if(now)).alias("contact_success_rate_this_month"),
        ratio(F.count_if(ok & recent), F.count_if(recent)).alias("contact_success_rate_3month"),
    )
    a, b = F.col("contact_success_rate_this_month"), F.col("contact_success_rate_3month")
    flags = ["has_ever_successful_contact", "has_successful_contact_this_month"]
    return (
        members.select("member_id").distinct().join(per_member, "member_id", "left")
        .withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})
        .withColumn("contact_success_trend", F.when(a > b, "up").when(a < b, "down").when(a == b, "same"))
    )


def responsiveness(spine: DataFrame, calls: DataFrame, within_days: int = 2, missed_at_most: int = 1,
                   place: Callable[[DataFrame], DataFrame] = lambda months: months) -> DataFrame:
    """1 in months with a missed call that no longer call followed within the given days."""
    dated = calls.withColumnRenamed("contact_date", "event_date")
    missed = dated.where(F.col("duration") <= missed_at_most)
    answered = dated.where(F.col("duration") > missed_at_most)
    followed = lb.first_followup(missed, answered, within_days)
    return lb.month_windows(spine, [(followed, "event_date", [
        lb.MonthMeasure({"is_potentially_not_responsive": (0, 0)}, F.col("first_followup").isNull()),
    ])], place=place)


def message_flags(spine: DataFrame, messages: DataFrame, burst: int = 5, weight: str | None = None,
                  place: Callable[[DataFrame], DataFrame] = lambda months: months) -> DataFrame:
    """Any message in the month, and any day with at least ``burst`` messages (``weight`` of them in a row)."""
    per_day = messages.groupBy("member_id", "contact_date").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return lb.month_windows(spine, [(per_day, "contact_date", [
        lb.MonthMeasure({"texted_in_month": (0, 0)}, F.col("n") > 0),
        lb.MonthMeasure({"likes_to_converse_by_text_in_month": (0, 0)}, F.col("n") >= burst),
    ])], place=place)


def engagement_flags(spine: DataFrame, engagement: DataFrame, contact: DataFrame, phone: DataFrame,
                     sms: DataFrame) -> DataFrame:
    return star_join(spine.select(*KEYS), [engagement, contact, phone, sms])


def engagement_trends(flags: DataFrame, step: float = 0.2) -> DataFrame:
    """Month-over-month transitions of the assembled engagement flags."""
    phone, text, talk = "is_potentially_not_responsive", "texted_in_month", "likes_to_converse_by_text_in_month"
    moved = wn.change("success_rate_this_month")
    return flags.select(
        "*",
        wn.turned(phone, 0, 1).alias("became_non_responsive"), wn.turned(phone, 1, 0).alias("became_responsive"),
        wn.change(phone).alias("increase_in_missed_calls"), wn.turned(phone, 0, 1).alias("new_missed_calls"),
        wn.turned(text, 0, 1).alias("started_texting"), wn.turned(text, 1, 0).alias("stopped_texting"),
        wn.turned(talk, 0, 1).alias("started_conversing"), wn.turned(talk, 1, 0).alias("stopped_conversing"),
        flag(moved >= step).alias("success_rate_increased"), flag(moved <= -step).alias("success_rate_decreased"),
    )


def star_join(spine: DataFrame, blocks: Sequence[DataFrame], member_blocks: Sequence[DataFrame] = (),
              keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Left-join every block to the spine.

    Member-level blocks go first while the rows are narrow. All month-level joins share one key, so the spine is
    shuffled once for all of them.
    """
    out = reduce(lambda a, b: a.join(b, "member_id", "left"), member_blocks, spine)
    return reduce(lambda a, b: a.join(b, list(keys), "left"), blocks, out)


def notes_months(spine: DataFrame, scores: DataFrame, high: int = 3) -> DataFrame:
    """Per note category: present this month, and three-state high flag."""
    measures, names = [], [c.lower() for c in codes.NOTE_CATEGORIES]
    for name in names:
        own = F.col("category") == name.upper()
        measures += [lb.MonthMeasure({f"{name}_present_this_month": (0, 0)}, own),
                     lb.MonthMeasure({f"_{name}_high": (0, 0)}, own & (F.col("score") >= high))]
    wide = lb.month_windows(spine, [(scores, "note_date", measures)])
    return wide.select(
        *KEYS,
        *[F.col(f"{n}_present_this_month") for n in names],
        *[F.when(F.col(f"_{n}_high") == 1, 1).when(F.col(f"{n}_present_this_month") == 1, 0)
          .alias(f"{n}_score_high_this_month") for n in names],
    )


def month_labels(event_months: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Events in the next one, two and three months, and still enrolled three months on.

    ``event_months`` has ed_events_in_month and ip_events_in_month per enrolled member-month.
    """
    dated = F.col("month").isNotNull()
    # a largest value needs no reduction before: the month of a member is spine and fact in one row
    own = event_months.select(
        "member_id", month_number("month").alias("_m"), F.lit(1).alias("_spine"), "month",
        *[flag(dated & (F.col(f"{k}_events_in_month") > 0)).alias(f"_{k}") for k in ("ed", "ip")])
    seen = enrolled.where(dated & (F.col("is_enrolled") == 1)).select("member_id", month_number("month").alias("_m"), F.lit(1).alias("_stays"))
    order = W.partitionBy("member_id").orderBy("_m")

    def any_in(value: str, first: int, last: int) -> Column:
        return F.coalesce(F.max(value).over(order.rangeBetween(first, last)), F.lit(0))

    ahead = {f"{k}_event_next_{30 * n}d": any_in(f"_{k}", 1, n) for k in ("ed", "ip") for n in (1, 2, 3)}
    ahead["is_active_next_90d"] = any_in("_stays", 3, 3)
    out = own.unionByName(seen, allowMissingColumns=True).select("member_id", "month", "_spine", *[c.alias(n) for n, c in ahead.items()])
    return out.where("_spine = 1").select(*KEYS, *ahead)


def cohort_window(dataset: DataFrame, qualifies: Column, months_before: int = 12) -> DataFrame:
    """Rows of members that ever qualify, from ``months_before`` months ahead of their first qualifying month."""
    first = dataset.where(qualifies).groupBy("member_id").agg(F.min("month").alias("_first"))
    return dataset.join(first, "member_id").where(
        F.col("month") >= F.add_months("_first", -months_before)).drop("_first")


def master_cohort(dataset: DataFrame, engaged: Column, months_after: int = 3) -> DataFrame:
    """Engaged members up to ``months_after`` months past their first month, and all rows of the others, without repeats."""
    first = dataset.where(engaged).groupBy("member_id").agg(F.min("month").alias("_first"))
    joined = dataset.join(first, "member_id", "left")
    keep = F.col("_first").isNull() | (F.col("month") <= F.add_months("_first", months_after))
    return joined.where(keep).drop("_first").distinct()
