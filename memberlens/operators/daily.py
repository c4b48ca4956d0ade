"""The member-day table: lookback blocks, note scores, assembly and longitudinal features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.functions.expr import (
    age_in_years, flag, gender_flags, is_ed_line, is_ip_line, months_crossed, one_hot, synonym, weekday_from_sunday,
)
from memberlens.operators import lookback as lb
from memberlens.operators import windows as wn

KEYS = ["member_id", "event_date"]
CLAIM_SPANS = [lb.DaySpan("90d", 90), lb.DaySpan("180d", 180), lb.DaySpan("90_180d", 180, 91)]


def claim_lookback(anchors: DataFrame | None, claims: DataFrame, lag_months: int = 4, extra: Sequence[lb.Measure] = ()) -> DataFrame:
    """Paid amount and distinct ED / IP days over 90, 180 and 90-to-180 days, seen only once old enough.

    With a lag of four months nothing is younger than 120 days, so the 90-day columns are all zero; they are kept
    because the published table has them.
    """
    dated = claims.withColumn("_claim_date", F.coalesce("service_date", "service_end_date"))
    return lb.day_lookback(anchors, dated, [
        lb.Measure("paid_sum", F.col("paid_amount")),
        lb.Measure("cnt_ed_visits", is_ed_line("place_of_service", "revenue_code"), "days"),
        lb.Measure("cnt_ip_visits", is_ip_line("place_of_service", "revenue_code"), "days"),
        *extra,
    ], CLAIM_SPANS, fact_date="_claim_date", lag_months=lag_months)


def _log_lookback(anchors: DataFrame | None, events: DataFrame, own: Column, block: lb.DayBlock) -> DataFrame:
    """Lookback over the events of a log for which ``own`` holds.

    Without ``anchors`` every day of the log is one, whatever happened on it: the log is read once for anchors and facts, and
    a log that lies together by person is not moved.
    """
    facts = events if anchors is None else events.where(own)
    return lb.day_lookback(anchors, facts, block.measures, block.spans, lag_months=block.lag_months)


def _log_block(own: Column, measures: Sequence[lb.Measure], spans: Sequence[lb.DaySpan], lag_months: int = 0) -> lb.DayBlock:
    """Measures of the events of a log for which ``own`` holds."""
    return lb.DayBlock([lb.Measure(m.name, F.when(own, m.value), m.kind) for m in measures], spans, lag_months)


def claim_event_block(lag_months: int = 4) -> lb.DayBlock:
    short = F.col("hcpcs_category_short")
    return _log_block(F.col("event_type").startswith("CLAIM_"), [
        lb.Measure("paid_sum", F.col("paid_amount")),
        lb.Measure("cnt_ed_visits", F.col("is_ed_event"), "days"), lb.Measure("cnt_ip_visits", F.col("is_ip_event"), "days"),
        *[lb.Measure(f"cnt_hcc_{c}", F.col(f"cnt_hcc_{c}") > 0, "count") for c in codes.CONDITION_GROUPS],
        lb.Measure("cnt_any_hcc", F.col("hcc_category").isNotNull(), "count"),
        *[lb.Measure(f"cnt_proc_{c}", short == c, "count") for c in ("psychotherapy", "psychiatric_evals")],
        lb.Measure("cnt_outpatient", ~(F.col("is_ed_event") | F.col("is_ip_event")), "count"),
    ], CLAIM_SPANS, lag_months)


def claim_event_lookback(anchors: DataFrame | None, events: DataFrame, lag_months: int = 4) -> DataFrame:
    """The published claim block over the event log: amounts, ED / IP days, conditions, categories and procedures.

    It counts events, so the amount of a line enters once for each event the line gives. Without ``anchors`` every day of the log
    is one.
    """
    return _log_lookback(anchors, events, F.col("event_type").startswith("CLAIM_"), claim_event_block(lag_months))


def fill_event_block(lag_months: int = 2) -> lb.DayBlock:
    return _log_block(
        F.col("event_type") == "PHARMACY_FILL",
        [lb.Measure(f"cnt_fills_{c}", F.col(f"is_fill_{c}"), "count") for c in codes.DAILY_DRUG_CLASSES],
        [lb.DaySpan("90d", 90), lb.DaySpan("180d", 180)], lag_months)


def fill_event_lookback(anchors: DataFrame | None, events: DataFrame, lag_months: int = 2) -> DataFrame:
    """Number of fills per drug class over 90 and 180 days. Without ``anchors`` every day of the log is one."""
    return _log_lookback(anchors, events, F.col("event_type") == "PHARMACY_FILL", fill_event_block(lag_months))


def _of_types(types: Sequence[str] | None) -> Column:
    return F.lit(True) if types is None else F.col("event_type").isin(list(types))


def realtime_block(types: Sequence[str] | None = None) -> lb.DayBlock:
    names = ["is_ip_adt", "is_ip_auth", "is_ip_hc", "is_ed_adt", "is_ed_auth", "is_ed_hc"]
    return _log_block(_of_types(types), [lb.Measure("cnt_" + n.removeprefix("is_"), F.col(n), "days") for n in names],
                      [lb.DaySpan("90d", 90), lb.DaySpan("180d", 180)])


def realtime_lookback(anchors: DataFrame | None, events: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Distinct admission days per unlagged source over 90 and 180 days, of the given event types or of all.

    Without ``anchors`` every day of the log is one.
    """
    return _log_lookback(anchors, events, _of_types(types), realtime_block(types))


def note_scores_of_day(columns: Mapping[str, str] = codes.NOTE_SCORE_COLUMNS) -> dict[str, Column]:
    """The pivot below over events of a log, as aggregates of a member-day."""
    noted = F.col("event_type") == "CARE_NOTE"
    return {name: F.max(F.when(noted & (F.col("code") == c), F.col("score"))) for c, name in columns.items()}


def note_pivot(scores: DataFrame, columns: Mapping[str, str] = codes.NOTE_SCORE_COLUMNS) -> DataFrame:
    """Largest score per category of the day, one column per category."""
    pivoted = scores.groupBy(*KEYS).pivot("category", list(columns)).agg(F.max("score"))
    return pivoted.select(*KEYS, *[F.col(c).alias(name) for c, name in columns.items()])


def with_inconsistency(features: DataFrame, rules: Mapping[str, Column], n: int = 60, mode: str = "days") -> DataFrame:
    """Per rule, whether it held on the day or within the ``n`` days (or rows) before it."""
    w = wn.trailing(n, mode, include_current=True)
    return features.select("*", *[F.max(flag(rule)).over(w).alias(name) for name, rule in rules.items()])


def adherence_rules() -> dict[str, Column]:
    """Stated behaviour against observed behaviour, on the columns of the member-day table."""
    return {
        "inconsistency_med_noncompliance":
            (F.col("note_med_adherence_score") > 3) & (F.col("mpr_antipsychotic_90d") < 0.2),
        "inconsistency_appt_noncompliance":
            (F.col("note_care_engagement_score") > 0.5) & (F.col("cnt_outpatient_90_180d") == 0),
    }


def member_day_table(features: DataFrame, members: DataFrame, labels: DataFrame | None, blocks: Sequence[DataFrame] = ()) -> DataFrame:
    """Join all blocks to the spine carried by ``features``; labels that saw nothing are 0. Without ``labels`` the features have them."""
    out = features
    for block in blocks:
        out = out.join(block, KEYS, "left")
    out = out.join(members, "member_id")
    if labels is not None:
        out = out.join(labels, KEYS, "left")
    y = [c for c in (features if labels is None else labels).columns if c.startswith("y_")]
    return out.select(*[c for c in out.columns if c not in y], *[F.coalesce(c, F.lit(0)).alias(c) for c in y])


def feed_days(feed: DataFrame, horizons: Sequence[int], counts: Mapping[str, tuple[Column, str]], span: int = 7, setting: str = "setting",
              date: str = "admit_date", scores: Mapping[str, str] = codes.NOTE_SCORE_COLUMNS) -> DataFrame:
    """Member-days of one scored feed with counts of the days before, note scores and labels, from a single reduction.

    The feed is brought to one row per person and day with everything that is asked of a day; windows and labels are range
    frames over those rows, so it is read and shuffled once. ``counts`` maps a name to (condition, ``days`` or ``count``).
    """
    def of_day(condition: Column, kind: str) -> Column:
        return F.count_if(condition) if kind == "count" else F.max(flag(condition)).cast("bigint")

    days = feed.where(F.col("member_id").isNotNull() & F.col(date).isNotNull()).groupBy("member_id", F.col(date).alias("event_date")).agg(
        F.max(flag(synonym(setting, codes.ED_SYNONYMS))).alias("any_ed_on_date"), F.max(flag(synonym(setting, codes.IP_SYNONYMS))).alias("any_ip_on_date"),
        *[of_day(condition, kind).alias(f"_{name}") for name, (condition, kind) in counts.items()],
        *[F.max(F.when(F.col("category") == c, F.col("score"))).alias(name) for c, name in scores.items()])
    before = wn.trailing(span)
    labelled = wn.with_labels(days.select("*", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"{n}_{span}d") for n in counts]), horizons)
    y = [f"y_{k}_{n}d" for n in horizons for k in ("ed", "ip", "any")]
    return labelled.select(*KEYS, *[f"{n}_{span}d" for n in counts], *scores.values(), *[F.coalesce(c, F.lit(0)).alias(c) for c in y])


def longitudinal(features: DataFrame, deltas: Mapping[str, str] = {}, since: Mapping[str, str] = {},
                 rolling: Mapping[str, str] = {}, new: Mapping[str, str] = {}, n: int = 30, n_new: int = 30,
                 mode: str = "days") -> DataFrame:
    """Deltas to the moving mean, days since last seen, moving sums and newly-positive flags in one sorted pass."""
    w = wn.trailing(n, mode)
    return features.select(
        "*",
        *[wn.delta_to_mean(c, w).alias(name) for c, name in deltas.items()],
        *[wn.days_since_last(c).alias(name) for c, name in since.items()],
        *[F.sum(c).over(w).alias(name) for c, name in rolling.items()],
        *[wn.newly_positive(c, n_new).alias(name) for c, name in new.items()],
    )


def first_dates(days: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Per member, the first day each flag is positive."""
    return days.groupBy("member_id").agg(
        *[F.min(F.when(F.col(c) > 0, F.col("event_date"))).alias(f"first_{name}_date") for name, c in flags.items()]
    )


def months_since_first(days: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Calendar months from the first positive day; negative before it, NULL when it never happens."""
    firsts = first_dates(days, flags)
    return days.join(firsts, "member_id").select(
        *days.columns,
        *[months_crossed(f"first_{name}_date", "event_date").alias(f"months_since_first_{name}") for name in flags],
    )


def with_intervention_period(days: DataFrame, note_score: str, engaged: Column) -> DataFrame:
    """1 for engaged members on and after their first note."""
    first = days.where(F.col(note_score).isNotNull()).groupBy("member_id").agg(F.min("event_date").alias("first_note_date"))
    return days.join(first, "member_id", "left").withColumn(
        "has_care_notes_post_period", flag(engaged & (F.col("event_date") >= F.col("first_note_date")))
    )


def with_snapshot(facts: DataFrame, snapshot: DataFrame, values: Sequence[str], date: str = "event_date",
                  default: float = codes.DEFAULT_RISK_SCORE) -> DataFrame:
    """Yearly risk scores of the payment year that follows the event's year; a default where there is none."""
    shifted = snapshot.select("member_id", (F.col("payment_year") - 1).alias("_year"), *values)
    out = facts.withColumn("_year", F.year(date)).join(shifted, ["member_id", "_year"], "left").drop("_year")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(default)) for v in values})


def modelling_columns(days: DataFrame) -> DataFrame:
    """Calendar parts, age and the one-hot columns of the modelling table."""
    return days.select(
        "*", weekday_from_sunday("event_date").alias("day_of_week"), F.month("event_date").alias("month"),
        F.year("event_date").alias("year"), age_in_years("dob", "event_date").alias("age"), *gender_flags("gender"),
        *one_hot("engagement_group", ["engaged_in_program", "selected_not_engaged", "not_selected_for_engagement"], "is_", None),
        *one_hot("normalized_coverage", ["TANF", "EXPANSION", "DSNP", "ABD"], "is_category_", None),
    )
