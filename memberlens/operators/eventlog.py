"""One tall event log from unlike feeds, and the member-day signals and labels drawn from it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions import codes
from memberlens.functions.expr import (
    engagement_group, first_filled, flag, group_flags, is_ed_line, is_ip_line, months_crossed, normalised_code,
    normalised_value, prefix, synonym,
)
from memberlens.operators.tabular import full_outer
from memberlens.operators.windows import with_labels
from memberlens.sources.tables import spread

CONDITION_COLUMNS = [f"cnt_hcc_{name}" for name in codes.CONDITION_GROUPS] + ["cnt_hcc_other_complex"]
THEME_COLUMNS = [f"has_{name}" for name in codes.THEMATIC_GROUPS]
FILL_COLUMNS = [f"is_fill_{name}" for name in codes.DAILY_DRUG_CLASSES]
SOURCE_COLUMNS = ["is_ip_adt", "is_ip_auth", "is_ip_hc", "is_ed_adt", "is_ed_auth", "is_ed_hc"]


def _fields(names: Iterable[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


EVENT_SCHEMA = T.StructType(
    [T.StructField("member_id", T.LongType()), T.StructField("event_date", T.DateType())]
    + _fields(["event_type"], T.StringType())
    + _fields(["claim_id"], T.LongType())
    + _fields(["claim_line_number"], T.IntegerType())
    + _fields(["place_of_service", "revenue_code", "code_type", "code", "code_family"], T.StringType())
    + _fields(["hcc_category"], T.IntegerType())
    + _fields(CONDITION_COLUMNS + THEME_COLUMNS, T.IntegerType())
    + _fields(["hcpcs_category", "hcpcs_category_short", "hcpcs_code"], T.StringType())
    + _fields(["paid_amount"], T.DecimalType(31, 9))
    + _fields(["is_ed_event", "is_ip_event"], T.BooleanType())
    + _fields(["score", "confidence"], T.LongType())
    + _fields(["population_baseline", "market_baseline", "individual_baseline"], T.DoubleType())
    + _fields(["evidence", "combined_notes", "raw_response"], T.StringType())
    + _fields(FILL_COLUMNS + SOURCE_COLUMNS, T.BooleanType())
)
"""The common event shape. A feed fills the columns it has; the rest are typed NULLs."""


def cohort(members: DataFrame, qualification: DataFrame | None, asof: Column, key: str = "member_id") -> DataFrame:
    """Qualified members with a market and an admissible coverage, one row each.

    Expects market, coverage, has_ever_been_engaged, is_batched and first_selected_date; ``asof`` stands for today.
    """
    base = members
    if qualification is not None:
        base = base.join(qualification.where("is_qualified = 1").select(key), key, "left_semi")
    return (
        base.where(F.col("market").isNotNull())
        .where(~F.upper(F.trim("coverage")).isin(codes.EXCLUDED_COVERAGE))
        .withColumn("normalized_coverage", normalised_value("coverage", codes.COVERAGE_SYNONYMS))
        .withColumn("engagement_group", engagement_group("has_ever_been_engaged", "is_batched"))
        .withColumn("months_since_batched", months_crossed("first_selected_date", asof))
    )


def mapped_diagnoses(diagnoses: DataFrame, code_map: DataFrame, version: str = codes.CODE_MAP_VERSION,
                     year: int = codes.CODE_MAP_YEAR) -> DataFrame:
    """Diagnoses with their category code, matched on the code without dots.

    The version and year are fixed before the join and the map is reduced to one row per code, so that no diagnosis
    is doubled. Spark broadcasts the map when its measured size allows.
    """
    wanted = (
        code_map.where((F.col("model_version") == version) & (F.col("payment_year") == year))
        .groupBy(normalised_code("diagnosis_code").alias("_norm"))
        .agg(F.max("hcc_code").alias("hcc_code"))
    )
    return (
        diagnoses.withColumn("_norm", normalised_code("icd_code"))
        .join(wanted, "_norm", "left")
        .drop("_norm")
    )


def diagnosis_rollup(mapped: DataFrame) -> DataFrame:
    """One row per claim with the largest category code and 0/1 condition and theme flags."""
    flagged = mapped.select(
        "member_id", "claim_id", F.col("hcc_code").alias("hcc_category"),
        *group_flags("hcc_code", codes.CONDITION_GROUPS, "cnt_hcc_", other="other_complex"),
        *group_flags("hcc_code", codes.THEMATIC_GROUPS, "has_"),
    )
    return flagged.groupBy("member_id", "claim_id").agg(
        *[F.max(c).alias(c) for c in ["hcc_category", *CONDITION_COLUMNS, *THEME_COLUMNS]]
    )


#: What possession ratios add up, for a log that carries it beside the common shape.
SUPPLY = T.StructField("days_supply", T.LongType())


def conformed(df: DataFrame, extra: Sequence[T.StructField] = ()) -> DataFrame:
    """Bring a feed to the common event shape and ``extra`` columns: absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in (*EVENT_SCHEMA.fields, *extra)
    ])


def _claim_base(lines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return lines.select(
        "member_id", F.coalesce("service_date", "service_end_date").alias("event_date"), "claim_id",
        "claim_line_number", "place_of_service", "revenue_code", "hcpcs_code", "paid_amount", *extra,
        is_ed_line("place_of_service", "revenue_code").alias("is_ed_event"),
        is_ip_line("place_of_service", "revenue_code").alias("is_ip_event"),
        *[F.lit(False).alias(c) for c in SOURCE_COLUMNS],
    )


def diagnosis_events(lines: DataFrame, mapped: DataFrame, located: bool = False) -> DataFrame:
    """Claim lines that have a diagnosis, each once, with the claim's condition flags.

    Diagnoses are rolled up per claim before the join; joining first would multiply lines by diagnoses. ``located`` says that both
    inputs lie together by member already, so that nothing has to be moved.
    """
    claim = ["member_id", "claim_id"]
    dealt = (lambda df: df) if located else (lambda df: spread(df, claim, lines))
    distinct_lines = dealt(lines).dropDuplicates([
        "member_id", "claim_id", "claim_line_number", "service_date", "service_end_date", "place_of_service",
        "revenue_code", "hcpcs_code", "paid_amount",
    ])
    joined = distinct_lines.join(diagnosis_rollup(dealt(mapped)), claim)
    return _claim_base(joined, ["hcc_category", *CONDITION_COLUMNS, *THEME_COLUMNS]).withColumns({
        "event_type": F.lit("CLAIM_DIAGNOSIS"), "code_type": F.lit("ICD10"),
    })


def line_events(lines: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Revenue and procedure events of all claim lines from one pass: a line gives up to two events.

    ``categories`` (hcpcs_code, hcpcs_category, hcpcs_category_short) names the kind of procedure.
    """
    base = _claim_base(lines)
    if categories is not None:
        named = categories.groupBy(F.upper(F.trim("hcpcs_code")).alias("_code")).agg(
            F.max("hcpcs_category").alias("_category"), F.max("hcpcs_category_short").alias("_short"))
        base = base.join(named, F.upper(F.trim("hcpcs_code")) == F.col("_code"), "left").drop("_code")
    else:
        base = base.withColumns({"_category": F.lit(None).cast("string"), "_short": F.lit(None).cast("string")})

    def event(kind: str, code_type: str, code: str, family: Column, category: Column, short: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), F.lit(code_type).alias("code_type"), F.col(code).alias("code"),
                        family.alias("code_family"), category.alias("hcpcs_category"), short.alias("hcpcs_category_short"))

    none = F.lit(None).cast("string")
    family = F.when(F.col("hcpcs_code").rlike("^[A-Z]"), prefix("hcpcs_code", 1))
    found = F.array(
        F.when(F.col("revenue_code").isNotNull(), event("CLAIM_REVENUE", "REV", "revenue_code", prefix("revenue_code", 3), none, none)),
        F.when(F.col("hcpcs_code").isNotNull(),
               event("CLAIM_PROCEDURE", "HCPCS", "hcpcs_code", family, F.col("_category"), F.col("_short"))))
    exploded = base.withColumn("_event", F.explode(F.filter(found, lambda e: e.isNotNull())))
    return exploded.select("*", "_event.*").drop("_event", "_category", "_short")


def note_events(scores: DataFrame) -> DataFrame:
    """Scored note categories (member_id, note_date, category, score, ...) as events."""
    return scores.withColumns({
        "event_date": F.col("note_date"), "event_type": F.lit("CARE_NOTE"), "code_type": F.lit("NOTE_CATEGORY"),
        "code": F.upper(F.trim("category")), "is_ed_event": F.lit(False), "is_ip_event": F.lit(False),
        **{c: F.lit(False) for c in SOURCE_COLUMNS},
    })


def fill_events(fills: DataFrame, code_columns: Sequence[str] = ("ndc",)) -> DataFrame:
    """Pharmacy fills with a date and a positive supply; class flags come in as is_<class>."""
    return fills.where(F.col("filled_date").isNotNull() & (F.col("days_supply") > 0)).withColumns({
        "event_date": F.col("filled_date"), "event_type": F.lit("PHARMACY_FILL"), "code_type": F.lit("NDC"),
        "code": first_filled(*[F.col(c).cast("string") for c in code_columns]),
        "is_ed_event": F.lit(False), "is_ip_event": F.lit(False),
        **{f"is_fill_{c}": F.coalesce(F.col(f"is_{c}"), F.lit(False)) for c in codes.DAILY_DRUG_CLASSES},
        **{c: F.lit(False) for c in SOURCE_COLUMNS},
    })


def admission_events(feed: DataFrame, event_type: str, source: str, setting: str = "setting",
                     date: str = "admit_date") -> DataFrame:
    """Admissions of one feed; ``source`` (adt, auth or hc) selects the source flags it sets."""
    ed, ip = synonym(setting, codes.ED_SYNONYMS), synonym(setting, codes.IP_SYNONYMS)
    own = {f"is_ed_{source}": ed, f"is_ip_{source}": ip}
    return feed.where(F.col(date).isNotNull()).withColumns({
        "event_date": F.to_date(date), "event_type": F.lit(event_type), "code_type": F.lit(f"{event_type}_TYPE"),
        "code": F.col(setting), "is_ed_event": ed, "is_ip_event": ip,
        **{c: own.get(c, F.lit(False)) for c in SOURCE_COLUMNS},
    })


def event_log(feeds: Sequence[DataFrame], members: DataFrame | None = None, extra: Sequence[T.StructField] = ()) -> DataFrame:
    """Union of all feeds in the common shape, restricted to the cohort when one is given."""
    log = reduce(DataFrame.unionByName, [conformed(f, extra) for f in feeds])
    if members is not None:
        log = log.join(members.select("member_id").distinct(), "member_id", "left_semi")
    return log


def union_feeds(feeds: Mapping[str, DataFrame], origin: str = "origin") -> DataFrame:
    """Union of unlike frames; columns a frame lacks are NULL, and each row says where it came from."""
    tagged = [df.withColumn(origin, F.lit(name)) for name, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def daily_signal(events: DataFrame) -> DataFrame:
    """Per member-day: any emergency or inpatient event, overall and by source."""
    named = {"any_ed_on_date": "is_ed_event", "any_ip_on_date": "is_ip_event", **{c: c for c in SOURCE_COLUMNS}}
    return events.groupBy("member_id", "event_date").agg(*[F.max(flag(F.col(c))).alias(n) for n, c in named.items()])


def diagnosis_signal(events: DataFrame) -> DataFrame:
    """Per member-day: thematic conditions on claims."""
    return (
        events.where(F.col("event_type") == "CLAIM_DIAGNOSIS")
        .groupBy("member_id", "event_date")
        .agg(*[F.max(flag(F.col(c) > 0)).alias(c) for c in THEME_COLUMNS])
    )


def combined_signal(events: DataFrame) -> DataFrame:
    """Member-days with both signals, missing ones as 0.

    A full outer join of the two signals gives the same rows; as both come from one log at one grain, a single
    aggregate does without the join and the second scan.
    """
    return events.groupBy("member_id", "event_date").agg(*[c.alias(n) for n, c in signals_of_day().items()])


def signals_of_day() -> dict[str, Column]:
    """Both signals as aggregates of a member-day."""
    named = {"any_ed_on_date": "is_ed_event", "any_ip_on_date": "is_ip_event", **{c: c for c in SOURCE_COLUMNS}}
    on_claim = F.col("event_type") == "CLAIM_DIAGNOSIS"
    return {n: F.max(flag(F.col(c))) for n, c in named.items()} | {c: F.max(flag(on_claim & (F.col(c) > 0))) for c in THEME_COLUMNS}


def line_signal(lines: DataFrame, mapped: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """The combined signal of claim lines and fills, straight from the lines.

    Flags are all that is needed, so the event shape is never built: a line gets its claim's conditions and counts if it
    would give an event (a diagnosed claim, a revenue or a procedure code); days with fills alone hold zeros.
    """
    rolled = diagnosis_rollup(mapped).select("member_id", "claim_id", *THEME_COLUMNS, F.lit(True).alias("_diagnosed"))
    seen = lines.join(rolled, ["member_id", "claim_id"], "left").where(
        F.col("_diagnosed") | F.col("revenue_code").isNotNull() | F.col("hcpcs_code").isNotNull())
    days = seen.select(
        "member_id", F.coalesce("service_date", "service_end_date").alias("event_date"),
        flag(is_ed_line("place_of_service", "revenue_code")).alias("any_ed_on_date"),
        flag(is_ip_line("place_of_service", "revenue_code")).alias("any_ip_on_date"),
        *[flag(F.coalesce(F.col(c), F.lit(0)) > 0).alias(c) for c in THEME_COLUMNS])
    names = days.columns[2:]
    if fills is not None:
        filled = fills.where(F.col("filled_date").isNotNull() & (F.col("days_supply") > 0))
        days = days.unionByName(filled.select("member_id", F.col("filled_date").alias("event_date"), *[F.lit(0).alias(c) for c in names]))
    return days.groupBy("member_id", "event_date").agg(*[F.max(c).alias(c) for c in names])


def joined_signals(daily: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Member-days of either signal when the two come from different logs."""
    return full_outer(daily, diagnosis, ["member_id", "event_date"])


def day_labels(signal: DataFrame, horizons: Sequence[int] = (30, 60, 90), mode: str = "days", carried: Sequence[str] = ()) -> DataFrame:
    """Look-ahead labels and same-day thematic labels per member-day, behind the ``carried`` columns.

    ``mode='rows'`` counts days that have events, as the published script does; ``'days'`` counts calendar days.
    The thematic labels mark the day itself although their usual name carries a horizon.
    """
    admitted = (F.col("any_ed_on_date") == 1) | (F.col("any_ip_on_date") == 1)
    themes = [flag(admitted & (F.col(c) == 1)).alias("y_" + c.removeprefix("has_").removesuffix("_thematic") + "_day")
              for c in THEME_COLUMNS if c in signal.columns]
    kept = [c for n in horizons for c in (f"y_ed_{n}d", f"y_ip_{n}d", f"y_any_{n}d")]
    return with_labels(signal, horizons, mode=mode).select("member_id", "event_date", *carried, *kept, *themes)


def labelled_events(events: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The published log: events with member attributes and the day's labels."""
    attributes = members.select(
        "member_id", "market", "dob", "gender", "engagement_group", "normalized_coverage", "months_since_batched",
        "has_ever_been_engaged", "is_batched",
    )
    return events.join(attributes, "member_id").join(labels, ["member_id", "event_date"], "left")
