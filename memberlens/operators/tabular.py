"""Relational steps that deserve a name: joins by rule, aggregates in one pass, shares and summaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.expr import flag, normalised_code
from memberlens.operators.windows import top_per_group
from memberlens.sources.tables import columns_by_keyword


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: float = 0) -> DataFrame:
    """Full outer join with merged keys and a constant for missing measures."""
    joined = left.join(right, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(fill)).alias(c) for c in joined.columns if c not in keys])


def exists_flag(df: DataFrame, lookup: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """1 where ``lookup`` has a row with the same keys; rows never multiply."""
    marks = lookup.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return df.join(marks, list(keys), "left").withColumn(name, flag(F.col("_hit").isNotNull())).drop("_hit")


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``excluded``; NULL keys of the list are ignored, so it cannot empty the result."""
    keys = excluded.select(key).where(F.col(key).isNotNull()).distinct()
    return df.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def scaffold(keys: DataFrame, categories: Sequence[str], column: str = "category") -> DataFrame:
    """Every key with every category. The categories are a fixed list, so this is an explode and not a join."""
    return keys.withColumn(column, F.explode(F.array(*[F.lit(c) for c in categories])))


def code_join(facts: DataFrame, code: str, dimension: DataFrame, dim_code: str, values: Sequence[str],
              where: Column | None = None) -> DataFrame:
    """Left join on codes without dots and case, to one dimension row per code."""
    rows = dimension if where is None else dimension.where(where)
    unique = rows.groupBy(normalised_code(dim_code).alias("_norm")).agg(*[F.max(v).alias(v) for v in values])
    return facts.withColumn("_norm", normalised_code(code)).join(unique, "_norm", "left").drop("_norm")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("record_count")).where(F.col("record_count") > 1)


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows are beyond the first of their key. NULL is a value of its own, as in a joined key text.

    Counting rows per key first keeps the distinct count in partial aggregates.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("total_rows"), F.count("*").alias("distinct_keys"),
                       (F.sum("n") - F.count("*")).alias("duplicate_rows"))


def share_of_total(df: DataFrame, by: Sequence[str], name: str = "share") -> DataFrame:
    """Rows per group and their share of all rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("row_count"))
    total = counts.agg(F.sum("row_count").alias("t"))
    return counts.withColumn(name, F.col("row_count") / total.scalar())


def rates_per_thousand(df: DataFrame, labels: Mapping[str, Column], key: str = "member_id") -> DataFrame:
    """Distinct members per thousand that ever have each label, one row per label.

    Labels are first reduced to one row per member, so the distinct counts are plain sums.
    """
    per_member = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(flag(c)).alias(n) for n, c in labels.items()])
    wide = per_member.agg(*[(F.sum(n) / F.count("*") * 1000).alias(n) for n in labels])
    return wide.unpivot([], list(labels), "label", "rate_per_1000_members")


def mean_of_member_max(df: DataFrame, values: Sequence[str], key: str = "member_id") -> DataFrame:
    """Each member's maximum, then the mean over members."""
    return df.groupBy(key).agg(*[F.max(v).alias(v) for v in values]).agg(*[F.avg(v).alias(f"avg_member_{v}") for v in values])


def ordered_text(df: DataFrame, by: Sequence[str], text: str, name: str, separator: str = " ", unique: bool = False,
                 count: str | None = None) -> DataFrame:
    """Texts of a group joined in text order; NULL counts as empty. ``unique`` keeps one of each repeated text.

    Repeats are counted before the shuffle, so a group meets as its distinct texts; the one string, whose size bounds what a
    group can hold, is built in the last step. ``count`` adds the number of rows.
    """
    per_text = df.groupBy(*by, F.coalesce(F.col(text), F.lit("")).alias("_text")).agg(F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct("_text", "_n")))
    texts = F.transform(parts, lambda p: p["_text"] if unique else F.array_join(F.array_repeat(p["_text"], p["_n"].cast("int")), separator))
    counted = [F.sum("_n").alias(count)] if count else []
    return per_text.groupBy(*by).agg(F.array_join(texts, separator).alias(name), *counted)


def conditional_distinct(df: DataFrame, by: Sequence[str], counts: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Distinct values under a condition, several of them per group, from one scan.

    A row gives a mark for its group and one for each condition it meets; marks are made distinct before and after one shuffle
    by group, measure and value, so neither a hot group nor a hot value is more than a row per task.
    """
    marks = [F.struct(F.lit(-1).alias("k"), F.lit("").alias("v"))]
    marks += [F.when(condition & value.isNotNull(), F.struct(F.lit(i).alias("k"), value.cast("string").alias("v"))) for i, (condition, value) in enumerate(counts.values())]
    long = df.select(*by, F.explode(F.array_compact(F.array(*marks))).alias("_m")).select(*by, "_m.k", "_m.v").distinct()
    return long.groupBy(*by).agg(*[F.count_if(F.col("k") == i).alias(name) for i, name in enumerate(counts)])


#: log2 of the buckets of a sketch; its relative error is about 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of the distinct values of every measure per group. Stored once per fine group (a month, say), sketches
    answer for any coarser one without another look at the rows."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(v, F.lit(bits)).alias(name) for name, v in values.items()])


def merged_sketches(sketches: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(n).alias(n) for n in names])


def estimates(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    others = [c for c in sketches.columns if c not in names]
    return sketches.select(*others, *[F.hll_sketch_estimate(n).alias(n) for n in names])


def within_error(estimate: Column, exact: Column, bits: int = SKETCH_BITS, deviations: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard errors of the exact count (or one unit, for tiny counts)."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * F.lit(deviations * 1.04 / 2 ** (bits / 2)))


def rolled_up(df: DataFrame, keys: Sequence[str], measures: Sequence[Column], total: str = "all") -> DataFrame:
    """Groups, subtotals of the leading keys and the grand total in one pass, one shuffle.

    ``level`` counts the keys that are summed over; such a key reads ``total``. A key that is null in the rows reads ``unknown``,
    so it never looks like a total.
    """
    known = df.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(f"_{k}") for k in keys])
    marks = [F.grouping(f"_{k}").alias(f"_over_{k}") for k in keys]
    rolled = known.rollup(*[f"_{k}" for k in keys]).agg(*measures, *marks)
    level = sum((F.col(f"_over_{k}").cast("int") for k in keys), F.lit(0))
    named = [F.when(F.col(f"_over_{k}") == 1, total).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    return rolled.select(*named, level.alias("level"), *[c for c in rolled.columns if not c.startswith("_")])


def as_map(df: DataFrame, by: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """Key-value rows of a group as one map, in key order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def yearly_summary(claims: DataFrame, date: str = "service_date", amount: str = "paid_amount") -> DataFrame:
    """Per year: members, claims, lines, averages per member and the mean of the members' own totals."""
    yearly = claims.withColumn("year", F.year(date))
    per_claim = yearly.groupBy("year", "member_id", "claim_id").agg(F.count("*").alias("lines"), F.sum(amount).alias("paid"))
    per_member = per_claim.groupBy("year", "member_id").agg(
        F.count("*").alias("claims"), F.sum("lines").alias("lines"), F.sum("paid").alias("paid"))
    return per_member.groupBy("year").agg(
        F.count("*").alias("members"), F.sum("claims").alias("claims"), F.sum("lines").alias("lines"),
        (F.sum("claims") / F.count("*")).alias("claims_per_member"), (F.sum("lines") / F.count("*")).alias("lines_per_member"),
        (F.sum("paid").cast("double") / F.count("*")).alias("mean_member_total"),
    )


def latest_periods(df: DataFrame, period: str, k: int) -> DataFrame:
    """Rows of the ``k`` latest distinct periods. Only ``k`` values are kept by the limit before the semi join."""
    last = df.select(period).where(F.col(period).isNotNull()).distinct().orderBy(F.col(period).desc()).limit(k)
    return df.join(F.broadcast(last), period, "left_semi")


def top_codes(diagnoses: DataFrame, visit_kinds: Mapping[str, Column], k: int = 5) -> DataFrame:
    """The ``k`` most frequent categories of each visit kind, then the ``k`` most frequent codes of these categories.

    Ties are broken by the code itself. ``diagnoses`` has hcc_code, icd_code and icd_desc.
    """
    known = diagnoses.where(F.col("hcc_code").isNotNull())
    any_kind = None
    for cond in visit_kinds.values():
        any_kind = cond if any_kind is None else any_kind | cond
    counts = known.where(any_kind).groupBy("hcc_code", "icd_code", "icd_desc").agg(
        F.count("*").alias("icd_count"), *[F.count_if(c).alias(f"_n_{name}") for name, c in visit_kinds.items()])
    per_category = counts.groupBy("hcc_code").agg(*[F.sum(f"_n_{n}").alias(f"_n_{n}") for n in visit_kinds])
    long = per_category.unpivot(["hcc_code"], [f"_n_{n}" for n in visit_kinds], "visit_type", "n").where(F.col("n") > 0)
    leaders = top_per_group(long, ["visit_type"], [F.desc("n"), F.asc("hcc_code")], k).select("hcc_code").distinct()
    mine = counts.join(leaders, "hcc_code", "left_semi").select("hcc_code", "icd_code", "icd_desc", "icd_count")
    return top_per_group(mine, ["hcc_code"], [F.desc("icd_count"), F.asc("icd_code"), F.asc("icd_desc")], k)


def categories_by_description(diagnoses: DataFrame, word: str) -> DataFrame:
    """Categories of the codes whose description mentions a word."""
    hit = F.upper("icd_desc").contains(word.upper())
    return diagnoses.where(hit & F.col("hcc_code").isNotNull()).select("hcc_code").distinct()


def outlier_flags(areas: DataFrame, directions: Mapping[str, str], area: str) -> DataFrame:
    """1 where an area's value lies more than one sample standard deviation on its bad side of the mean.

    ``directions`` maps a column to ``high`` or ``low``. All means and deviations come from one aggregate.
    """
    stats = areas.agg(F.struct(*[f(c).alias(f"{p}_{c}") for c in directions for p, f in (("m", F.avg), ("s", F.stddev_samp))]).alias("s"))
    joined = areas.withColumn("_stats", stats.scalar())
    picked = []
    for c, bad in directions.items():
        mean, sd = F.col(f"_stats.m_{c}"), F.col(f"_stats.s_{c}")
        picked.append(flag(F.col(c) > mean + sd if bad == "high" else F.col(c) < mean - sd).alias(f"{c}_outlier"))
    return joined.select(area, *picked)


def keyword_directions(metadata: DataFrame, keywords: Mapping[str, str], columns: Iterable[str]) -> dict[str, str]:
    """Columns whose description mentions a keyword, with the bad direction of that keyword.

    A column that several keywords name takes the first of them; described columns that the table does not have are left out.
    The metadata is as small as a table is wide.
    """
    order, present = {k: i for i, k in enumerate(keywords)}, set(columns)
    found: dict[str, tuple[int, str]] = {}
    for row in columns_by_keyword(metadata, keywords).collect():
        if row["code"] in present:
            found[row["code"]] = min(found.get(row["code"], (len(order), "")), (order[row["keyword"]], row["direction"]))
    return {c: found[c][1] for c in sorted(found)}
