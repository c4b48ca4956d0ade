"""Column expressions shared by the operators. All stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codes


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# ---- strings -------------------------------------------------------------------------------------------

def clean(value: Column | str) -> Column:
    return F.upper(F.trim(as_col(value)))


def prefix(value: Column | str, n: int) -> Column:
    return F.substring(as_col(value), 1, n)


def normalised_code(value: Column | str) -> Column:
    """Diagnosis code without dots, trimmed and in upper case."""
    return F.replace(clean(value), F.lit("."), F.lit(""))


def first_filled(*values: Column | str) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(as_col(v), F.lit("")) for v in values])


def fill_template(template: Column | str, values: Mapping[str, Column]) -> Column:
    """Put values into ``{{NAME}}`` placeholders."""
    out = as_col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def truncated(value: Column | str, limit: int) -> tuple[Column, Column]:
    """The first ``limit`` characters, and whether there were more."""
    text = as_col(value)
    return F.substring(text, 1, limit), F.length(text) > limit


def prefix_match(value: Column | str, pattern: str) -> Column:
    """Pattern found at the start of the value; NULL counts as no match.

    A warehouse that anchors patterns at both ends would reject longer codes; the prefix reading is the
    evident intent for revenue codes and is the one used here.
    """
    return F.coalesce(as_col(value).rlike(pattern), F.lit(False))


# ---- dates ---------------------------------------------------------------------------------------------

def month_start(value: Column | str) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(as_col(value), "MONTH")


def month_number(value: Column | str) -> Column:
    """Months since year 0, so that month windows become integer ranges."""
    d = as_col(value)
    return F.year(d) * 12 + F.month(d)


def day_number(value: Column | str) -> Column:
    """Days since 1970-01-01, so that day windows become integer ranges."""
    return F.unix_date(as_col(value))


def months_crossed(start: Column | str, end: Column | str) -> Column:
    """Calendar-month boundaries between two dates (whole months are not required)."""
    return month_number(end) - month_number(start)


def years_crossed(start: Column | str, end: Column | str) -> Column:
    return F.year(as_col(end)) - F.year(as_col(start))


def weekday_from_sunday(value: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(as_col(value)) - 1


def available_from(fact_date: Column | str, lag_months: int) -> Column:
    """First day on which ``fact_date <= add_months(day, -lag_months)`` holds.

    When the month end clips the day (31 Oct plus four months), the fact becomes visible a day later.
    """
    d = as_col(fact_date)
    shifted = F.add_months(d, lag_months)
    return F.when(F.dayofmonth(shifted) < F.dayofmonth(d), F.date_add(shifted, 1)).otherwise(shifted)


def age_in_years(birth: Column | str, at: Column | str) -> Column:
    """Days divided by 365.25; NULL when the birth date lies after ``at``."""
    b, a = as_col(birth), as_col(at)
    return F.when(b <= a, F.datediff(a, b) / F.lit(365.25))


def date_or_fallback(value: Column | str, fallback: Column | str, asof: Column) -> Column:
    """The date, unless it is missing or after ``asof``: then the fallback."""
    d, other = F.to_date(as_col(value)), F.to_date(as_col(fallback))
    return F.when(d.isNull() | (d > asof), other).otherwise(d)


def calendar_flags(month: Column | str) -> list[Column]:
    m = as_col(month)
    return [F.year(m).alias("year")] + [
        flag(F.month(m) == i).alias(f"is_{name}") for i, name in enumerate(codes.MONTH_NAMES, start=1)
    ]


# ---- categories ----------------------------------------------------------------------------------------

def normalised_value(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Cleaned value with synonyms replaced."""
    text = clean(value)
    out = text
    for source, target in mapping.items():
        out = F.when(text == source, F.lit(target)).otherwise(out)
    return out


def priority_label(rules: Iterable[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule that holds."""
    chain = None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    if chain is None:
        raise ValueError("at least one rule is needed")
    return chain.otherwise(F.lit(otherwise))


def engagement_group(engaged: Column | str, selected: Column | str) -> Column:
    return priority_label(
        [(as_col(engaged), "engaged_in_program"), (as_col(selected), "selected_not_engaged")],
        "not_selected_for_engagement",
    )


def group_flags(code: Column | str, groups: Mapping[str, list[int]], prefix_: str = "",
                other: str | None = None) -> list[Column]:
    """One 0/1 column per code group; ``other`` marks codes that are present and in no group."""
    c = as_col(code)
    out = [flag(c.isin(members)).alias(f"{prefix_}{name}") for name, members in groups.items()]
    if other:
        known = sorted({m for members in groups.values() for m in members})
        out.append(flag(c.isNotNull() & ~c.isin(known)).alias(f"{prefix_}{other}"))
    return out


def group_name(code: Column | str, groups: Mapping[str, list[int]], other: str | None = None) -> Column:
    """The group a code belongs to, for long-form processing (groups must not overlap)."""
    c = as_col(code)
    rules = [(c.isin(members), name) for name, members in groups.items()]
    if other:
        rules.append((c.isNotNull(), other))
    return priority_label(rules)


def one_hot(value: Column | str, categories: Iterable[str], prefix_: str, other: str | None = "other") -> list[Column]:
    """One 0/1 column per category; ``other`` is 1 for NULL and for values outside the list."""
    c = as_col(value)
    listed = list(categories)
    out = [flag(c == v).alias(prefix_ + v.lower().replace(" ", "_")) for v in listed]
    if other:
        out.append(flag(c.isNull() | ~c.isin(listed)).alias(prefix_ + other))
    return out


def prefix_flags(value: Column | str, prefixes: Mapping[str, str], other: str = "is_other") -> list[Column]:
    """Flags by leading characters; NULL gives 0 everywhere, also for ``other``."""
    text = clean(value)
    hits = {name: prefix(text, len(p)) == p for name, p in prefixes.items()}
    none_of = F.lit(True)
    for hit in hits.values():
        none_of = none_of & ~hit
    return [flag(hit).alias(name) for name, hit in hits.items()] + [flag(none_of).alias(other)]


def band_start(value: Column | str, width: int) -> Column:
    return (F.floor(as_col(value) / F.lit(width)) * width).cast("int")


def band_flags(value: Column | str, low: int, high: int, width: int, prefix_: str) -> list[Column]:
    """One flag per half-open band from ``low`` to ``high``, and an open top band."""
    v = as_col(value)
    out = [
        flag((v >= lo) & (v < lo + width)).alias(f"{prefix_}{lo}_{lo + width - 1}")
        for lo in range(low, high, width)
    ]
    return out + [flag(v >= high).alias(f"{prefix_}{high}_plus")]


def gender_flags(gender: Column | str) -> list[Column]:
    first = prefix(F.upper(as_col(gender)), 1)
    return [
        flag(first == "M").alias("is_male"),
        flag(first == "F").alias("is_female"),
        flag(first.isNull() | ~first.isin("M", "F")).alias("is_gender_unknown"),
    ]


def synonym(value: Column | str, words: Iterable[str]) -> Column:
    return F.coalesce(F.lower(as_col(value)).isin(list(words)), F.lit(False))


def at_least(value: Column | str, threshold: float) -> Column:
    return flag(as_col(value) >= threshold)


def three_state(high: Column, present: Column) -> Column:
    """1 when high, 0 when present but not high, NULL when absent."""
    return F.when(high, 1).when(present, 0)


def gated(condition: Column, value: Column | str) -> Column:
    """The value where it applies, else NULL."""
    return F.when(condition, as_col(value))


# ---- encounters ----------------------------------------------------------------------------------------

def is_ed_line(place: Column | str, revenue: Column | str) -> Column:
    """Emergency line by place of service or revenue-code family."""
    return F.coalesce(as_col(place) == codes.ED_PLACE, F.lit(False)) | (
        prefix(F.coalesce(as_col(revenue), F.lit("")), 3) == codes.ED_REVENUE_PREFIX
    )


def is_ip_line(place: Column | str, revenue: Column | str) -> Column:
    """Inpatient line by place of service or revenue-code pattern."""
    return F.coalesce(as_col(place) == codes.IP_PLACE, F.lit(False)) | prefix_match(revenue, codes.IP_REVENUE_PATTERN)


# ---- numbers and labels --------------------------------------------------------------------------------

def either(*labels: Column | str) -> Column:
    """Largest of several 0/1 labels, with NULL as 0."""
    return F.greatest(*[F.coalesce(as_col(c), F.lit(0)) for c in labels])


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient, NULL when the divisor is 0 or NULL."""
    return F.try_divide(as_col(top).cast("double"), as_col(bottom).cast("double"))


# ---- whole frames --------------------------------------------------------------------------------------

def numeric_features(df: DataFrame, exclude: Iterable[str] = (), exclude_prefixes: Iterable[str] = (),
                     exclude_suffixes: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric columns not excluded (case-insensitively), and the columns skipped for their type."""
    banned = {e.strip().lower() for e in exclude}
    heads = tuple(p.lower() for p in exclude_prefixes)
    tails = tuple(s.lower() for s in exclude_suffixes)
    kept, skipped = [], []
    for field in df.schema.fields:
        name = field.name.strip().lower()
        if name in banned or (heads and name.startswith(heads)) or (tails and name.endswith(tails)):
            continue
        (kept if isinstance(field.dataType, T.NumericType) else skipped).append(field.name)
    return kept, skipped


def aligned(df: DataFrame, columns: Iterable[str], fill: float = 0) -> DataFrame:
    """Exactly the named columns in that order; missing ones are constant."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def as_doubles(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Lower-case all names and cast the listed columns to double."""
    wanted = {c.lower() for c in columns}
    picked = []
    for field in df.schema.fields:
        name = field.name.lower()
        picked.append(F.col(field.name).cast("double").alias(name) if name in wanted else F.col(field.name).alias(name))
    return df.select(*picked)
