"""Conditions, treatment, care coordination, pharmacy and facility use per member-month."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.functions.expr import at_least, flag, gated, group_name, month_number, month_start
from memberlens.operators import lookback as lb

KEYS = ["member_id", "month"]
CONDITIONS = [*codes.CONDITION_GROUPS, "other_complex"]


def with_condition(mapped: DataFrame) -> DataFrame:
    """Diagnoses in long form with their condition group; codes without a category are dropped."""
    return mapped.withColumn("condition", group_name("hcc_code", codes.CONDITION_GROUPS, "other_complex")).where(
        F.col("condition").isNotNull())


def first_diagnosis_dates(mapped: DataFrame) -> DataFrame:
    """Per member, the first date of each condition."""
    return with_condition(mapped).groupBy("member_id").agg(
        *[F.min(F.when(F.col("condition") == c, F.col("service_date"))).alias(f"first_{c}_date") for c in CONDITIONS])


def condition_months(spine: DataFrame, mapped: DataFrame, bounded: bool = False) -> DataFrame:
    return condition_flags(spine, first_diagnosis_dates(mapped), bounded)


def condition_flags(spine: DataFrame, firsts: DataFrame, bounded: bool = False) -> DataFrame:
    """Condition flags and first-diagnosis-month flags per member-month, from the first dates.

    Unbounded flags look at all diagnoses regardless of date, as the published table does; ``bounded`` counts a
    condition from the month of its first diagnosis. The first-diagnosis flag marks that month in both.
    """
    out = spine.select(*KEYS).join(firsts, "member_id", "left")
    picked = []
    for c in CONDITIONS:
        first = F.col(f"first_{c}_date")
        known = month_start(first) <= F.col("month") if bounded else first.isNotNull()
        picked += [flag(known).alias(f"has_{c}"), flag(month_start(first) == F.col("month")).alias(f"first_diagnosis_{c}")]
    return out.select(*KEYS, *picked)


def treatment_required(spine: DataFrame, mapped: DataFrame) -> DataFrame:
    return required_flags(spine, first_diagnosis_dates(mapped))


def required_flags(spine: DataFrame, firsts: DataFrame) -> DataFrame:
    """1 once a condition was diagnosed on or before the first day of the month, from the first dates."""
    out = spine.select(*KEYS).join(firsts, "member_id", "left")
    return out.select(*KEYS, *[flag(F.col(f"first_{c}_date") <= F.col("month")).alias(f"{c}_treatment_required")
                               for c in CONDITIONS])


def office_treatments(lines: DataFrame, mapped: DataFrame, places: Sequence[str] = codes.OFFICE_PLACES,
                      dx_lines: Sequence[int] = (1, 2)) -> DataFrame:
    """Distinct (member, month, condition, provider) of office claims with a leading diagnosis.

    Lines and diagnoses meet on the claim. Lines are reduced to the months they fall in and diagnoses to condition and
    provider first, so a claim with many lines and many diagnoses does not multiply.
    """
    visits = lines.where(F.col("place_of_service").isin(list(places))).select(
        "member_id", "claim_id", month_start("service_date").alias("service_month")).distinct()
    reasons = with_condition(mapped.where(F.col("dx_line_number").isin(list(dx_lines)))).select(
        "member_id", "claim_id", "condition", "provider_id").distinct()
    return visits.join(reasons, ["member_id", "claim_id"]).select(
        "member_id", "service_month", "condition", "provider_id").distinct()


def treatment_months(spine: DataFrame, treatments: DataFrame) -> DataFrame:
    """Treated before this month, in the three months ending with it, and in it, per condition."""
    measures = [
        lb.MonthMeasure({
            f"{c}_ever_treated": (W.unboundedPreceding, -1), f"{c}_treated_last_3_months": (-2, 0),
            f"{c}_treated_this_month": (0, 0),
        }, F.col("condition") == c) for c in CONDITIONS
    ]
    return lb.month_windows(spine, [(treatments, "service_month", measures)])


def care_coordination(spine: DataFrame, treatments: DataFrame, required: DataFrame) -> DataFrame:
    """Per required condition: exactly one provider in three months, and a provider not seen in the two months before.

    One distinct provider means smallest equals largest, and a new provider is one whose previous month lies more than
    two months back; neither needs the set of providers.
    """
    provider_months = treatments.select(
        "member_id", "condition", "provider_id", F.col("service_month").alias("month")
    ).where(F.col("provider_id").isNotNull()).distinct()
    by_month = provider_months.groupBy("member_id", month_number("month").alias("_m")).agg(*[
        agg(F.when(F.col("condition") == c, F.col("provider_id"))).alias(f"_{name}_{c}")
        for c in CONDITIONS for name, agg in (("lo", F.min), ("hi", F.max))
    ])
    marks = spine.select("member_id", month_number("month").alias("_m"), F.col("month").alias("month"))
    frame = W.partitionBy("member_id").orderBy("_m").rangeBetween(-2, 0)
    single = (
        marks.unionByName(by_month, allowMissingColumns=True)
        .select("member_id", "month", *[
            flag(F.min(f"_lo_{c}").over(frame) == F.max(f"_hi_{c}").over(frame)).alias(f"_one_{c}") for c in CONDITIONS
        ]).where(F.col("month").isNotNull())
    )
    before = F.lag(month_number("month")).over(W.partitionBy("member_id", "condition", "provider_id").orderBy("month"))
    fresh = provider_months.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") < month_number("month") - 2))
    new = lb.month_windows(spine, [(fresh, "month", [
        lb.MonthMeasure({f"_new_{c}": (0, 0)}, F.col("condition") == c) for c in CONDITIONS])])
    joined = required.join(single, KEYS).join(new, KEYS)
    picked = []
    for c in CONDITIONS:
        needed = F.col(f"{c}_treatment_required") == 1
        picked += [F.col(f"{c}_treatment_required"),
                   gated(needed, f"_one_{c}").alias(f"{c}_coordinated_care_last_3_months"),
                   gated(needed, f"_new_{c}").alias(f"{c}_new_provider_this_month")]
    return joined.select(*KEYS, *picked)


def pharmacy_months(spine: DataFrame, fills: DataFrame, classes: Mapping[str, Column], mode: str = "month",
                    adherent_at: float = codes.ADHERENT_AT, place: Callable[[DataFrame], DataFrame] = lambda months: months) -> DataFrame:
    """Per drug class: ever prescribed, number of drugs, possession ratio, adherence, missed refill and new drug.

    ``mode='month'`` works on calendar months: the last three are ``m-2`` to ``m``, and refills and first fills count
    for the month they fall in. ``mode='date'`` compares fill dates with the first day of the month, as the published
    script does: the window is ``[m-2, first day of m]`` and only fills on a first day count as refills or new drugs.

    Fills become one row per member and month, and a spine month looks at three of them: the two months before as a whole
    and, of its own, the fills that count at once. A drug counts once however many of its fills lie there: at its first fill
    in these months, whose previous one lies at least as many months before it as the months reach back from it. ``place``
    may lay the rows of fills where those of the spine lie.
    """
    by_date, names = mode == "date", list(classes)
    today = "_now" if by_date else ""  # what counts at once of the own month: else all of it
    taken = F.explode(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(classes.values())]))
    long = fills.where(F.col("filled_date").isNotNull()).select(
        "member_id", "ndc", "filled_date", "days_supply", taken.alias("class")).where(F.col("class").isNotNull()).distinct()
    drug = W.partitionBy("member_id", "class", "ndc").orderBy("filled_date", "days_supply")
    own = month_number("filled_date")
    seen = long.select("member_id", "class", own.alias("_m"), F.col("days_supply").cast("bigint").alias("_days"),
                       (F.dayofmonth("filled_date") == 1 if by_date else F.lit(True)).alias("_now"),
                       (own - F.lag(own).over(drug)).alias("_gap"))

    def fresh(months: int) -> Column:
        return F.col("_gap").isNull() | (F.col("_gap") >= months)

    measures = []
    for i, n in enumerate(names):
        hit, now = F.col("class") == i, (F.col("class") == i) & F.col("_now")
        for word, those in {"": hit, today: now}.items():
            measures += [F.sum(F.when(those, F.col("_days"))).alias(f"days{word}_{n}"), F.count_if(those & fresh(1)).alias(f"drugs{word}_{n}")]
        measures += [F.count_if(hit & fresh(2)).alias(f"fresh_{n}"), F.count_if(now & fresh(3)).alias(f"fresh_now_{n}"),
                     F.count_if(now & F.col("_gap").isNull()).alias(f"start_{n}")]
    by_month = seen.groupBy("member_id", "_m").agg(*measures)
    facts = by_month.select("member_id", "_m", F.struct(*by_month.columns[2:]).alias("_f"))
    marks = spine.select("member_id", month_number("month").alias("_m"), F.lit(1).alias("_spine"), F.col("month"))
    month = W.partitionBy("member_id").orderBy("_m")
    wide = marks.unionByName(place(facts), allowMissingColumns=True).select(
        "member_id", "month", "_spine",
        *[F.first("_f", ignorenulls=True).over(month.rangeBetween(-back, -back)).alias(f"_f{back}") for back in range(3)],
        *[F.sum(f"_f.drugs_{n}").over(month.rangeBetween(W.unboundedPreceding, -1)).alias(f"_before_{n}") for n in names],
    ).where(F.col("_spine") == 1)

    def cell(name: str, back: int = 0) -> Column:
        return F.coalesce(F.col(f"_f{back}.{name}"), F.lit(0))

    out = []
    for n in names:
        now, before = cell(f"drugs{today}_{n}") > 0, cell(f"drugs{today}_{n}", 1) > 0
        ever = now | (F.col(f"_before_{n}") > 0)
        mpr = (cell(f"days_{n}", 2) + cell(f"days_{n}", 1) + cell(f"days{today}_{n}")) / F.lit(90.0)
        out += [
            flag(ever).alias(f"{n}_ever_prescribed"),
            (cell(f"drugs_{n}", 2) + cell(f"fresh_{n}", 1) + cell(f"fresh_now_{n}")).alias(f"num_{n}_drugs_last_3_months"),
            gated(ever, mpr).alias(f"{n}_mpr_last_3_months"), gated(ever, at_least(mpr, adherent_at)).alias(f"{n}_med_adherent"),
            flag(before & ~now).alias(f"{n}_missed_refill_this_month"),
            flag(cell(f"start_{n}") > 0).alias(f"{n}_new_drug_this_month"),
        ]
    return wide.select(*KEYS, *out)


def facility_months(spine: DataFrame, lines: DataFrame) -> DataFrame:
    """Lab work in the 3, 6 and 12 months before the month; residential stays in it and in the three before."""
    place = F.col("place_of_service")
    return lb.month_windows(spine, [(lines, "service_date", [
        lb.MonthMeasure({f"lab_last_{n}_months": (-n, -1) for n in (3, 6, 12)}, place.isin(codes.LAB_PLACES)),
        lb.MonthMeasure({"snf_this_month": (0, 0), "snf_last_3_months": (-3, 0)}, place.isin(codes.SNF_PLACES)),
    ])])


def realtime_months(spine: DataFrame, admissions: DataFrame, checks: DataFrame) -> DataFrame:
    """Admissions and escalations of the month, and admissions of this and the three months before.

    ``admissions`` has event_date, is_ed_event and is_ip_event; ``checks`` has created_at, is_health_declining,
    has_medication_concerns, has_health_concerns, has_escalation, escalation_created_at, is_escalation_resolved and
    escalation_resolved_at.
    """
    open_ = ~F.coalesce(F.col("is_escalation_resolved"), F.lit(False))
    return lb.month_windows(spine, [
        (admissions, "event_date", [
            lb.MonthMeasure({"had_ed_event_this_month": (0, 0), "had_ed_event_last_3_months": (-3, 0)}, F.col("is_ed_event")),
            lb.MonthMeasure({"had_ip_event_this_month": (0, 0), "had_ip_event_last_3_months": (-3, 0)}, F.col("is_ip_event")),
        ]),
        (checks, "escalation_created_at", [
            lb.MonthMeasure({"needed_triage_escalation_this_month": (0, 0)}, F.col("has_escalation")),
            lb.MonthMeasure({"triage_escalation_unresolved_this_month": (0, 0)}, F.col("has_escalation") & open_),
        ]),
        (checks, "escalation_resolved_at", [
            lb.MonthMeasure({"triage_escalation_resolved_this_month": (0, 0)}, F.col("is_escalation_resolved")),
        ]),
        (checks, "created_at", [
            lb.MonthMeasure({"deteriorating_condition_this_month": (0, 0)}, F.col("is_health_declining") == "yes"),
            lb.MonthMeasure({"had_medication_concern_this_month": (0, 0)}, F.col("has_medication_concerns") == "yes"),
            lb.MonthMeasure({"had_medical_needs_this_month": (0, 0)}, F.col("has_health_concerns") == "yes"),
        ]),
    ])


def event_day_months(spine: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct ED and IP days in the month, in the three months ending with it, and in the three before those."""
    revenue = F.col("revenue_code")
    measures = [
        lb.MonthMeasure({f"{k}_events_in_month": (0, 0), f"{k}_events_last_3_months": (-2, 0),
                         f"{k}_events_last_3_6_months": (-5, -3)}, revenue.isin(listed), "days")
        for k, listed in (("ed", codes.ED_REVENUE_CODES), ("ip", codes.MONTH_IP_REVENUE_CODES))
    ]
    return lb.month_windows(spine, [(lines, "service_date", measures)])
