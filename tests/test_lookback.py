import datetime as dt
from decimal import Decimal
import random

import pytest
from pyspark.sql import functions as F

from memberlens.operators import lookback as lb
from tests.helpers import d, rows, table


def add_months(day, n):
    month = day.month - 1 + n
    year, month = day.year + month // 12, month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month, min(day.day, last))


def brute(anchors, facts, oldest, newest, lag_months, lag_days):
    out = {}
    for m, a in anchors:
        got = [f for f in facts if f[0] == m and a - dt.timedelta(days=oldest) <= f[1] <= a - dt.timedelta(days=newest)
               and f[1] <= add_months(a, -lag_months) and f[1] <= a - dt.timedelta(days=lag_days)]
        out[m, a] = (round(sum(f[2] or 0 for f in got), 4), sum(1 for f in got if f[3]), len({f[1] for f in got if f[3]}))
    return out


def measures():
    return [lb.Measure("v", F.col("v")), lb.Measure("n", F.col("hit"), "count"), lb.Measure("days", F.col("hit"), "days")]


SCHEMA = "member_id long, event_date date, v double, hit boolean"


@pytest.mark.parametrize("seed,lag_months,lag_days", [(1, 0, 0), (2, 0, 3), (3, 2, 0), (4, 4, 0), (5, 1, 20)])
def test_lookback_equals_brute_force(spark, seed, lag_months, lag_days):
    rng = random.Random(seed)
    start = dt.date(2023, 10, 1)
    facts = [(rng.randrange(4), start + dt.timedelta(days=rng.randrange(260)), rng.choice([None, round(rng.uniform(-5, 50), 2)]),
              rng.choice([True, False, None])) for _ in range(300)]
    facts += [(9, dt.date(2023, 10, 31), 1.5, True), (9, dt.date(2024, 2, 29), 2.5, True), (9, dt.date(2024, 3, 1), 4.0, False)]
    anchors = sorted({(f[0], f[1]) for f in facts} | {(9, dt.date(2024, 2, 29)), (9, dt.date(2024, 3, 31)), (77, dt.date(2024, 1, 1))})
    spans = [lb.DaySpan("90d", 90), lb.DaySpan("180d", 180), lb.DaySpan("90_180d", 180, 91)]
    got = lb.day_lookback(spark.createDataFrame(anchors, "member_id long, event_date date"), spark.createDataFrame(facts, SCHEMA),
                          measures(), spans, lag_months=lag_months, lag_days=lag_days)
    for span in spans:
        want = brute(anchors, facts, span.oldest, span.newest, lag_months, lag_days)
        s = span.suffix
        have = {k: (round(float(v), 4), n, c) for k, (v, n, c) in table(got, ["member_id", "event_date"], f"v_{s}", f"n_{s}", f"days_{s}").items()}
        assert have == want


def test_sweep_and_frames_agree(spark):
    rng = random.Random(11)
    facts = [(rng.randrange(3), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40)), float(rng.randrange(100)), rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(facts, SCHEMA)
    anchors = lb.member_days(df)
    marks = anchors.select("member_id", F.unix_date("event_date").alias("_day"), F.lit(1).alias("_anchor"))
    daily = df.groupBy("member_id", F.col("event_date").alias("_fact_day")).agg(F.sum(F.col("v").cast("bigint")).alias("v"))
    spans = [lb.DaySpan("7d", 7), lb.DaySpan("14d", 14, 3)]
    outputs = [(f"v_{s.suffix}", lb.Measure("v", F.col("v")), i) for i, s in enumerate(spans)]
    both = [rows(f(marks, daily, outputs, spans, "member_id", 0, 2).where("_anchor = 1").na.fill(0)) for f in (lb._framed, lb._swept)]
    assert both[0] == both[1]


def test_four_month_lag_leaves_ninety_days_empty(spark):
    facts = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, True) for i in range(200)], SCHEMA)
    got = lb.day_lookback(lb.member_days(facts), facts, measures(), [lb.DaySpan("90d", 90)], lag_months=4)
    assert got.agg(F.sum("days_90d")).first()[0] == 0


def test_window_edges(spark):
    facts = spark.createDataFrame([(1, d("2024-01-10"), 1.0, True)], SCHEMA)
    anchors = spark.createDataFrame([(1, d(x)) for x in ("2024-01-10", "2024-01-11", "2024-01-17", "2024-01-18")], "member_id long, event_date date")
    got = table(lb.day_lookback(anchors, facts, measures()[2:], [lb.DaySpan("7d", 7)]), "event_date", "days_7d")
    assert got == {d("2024-01-10"): 0, d("2024-01-11"): 1, d("2024-01-17"): 1, d("2024-01-18"): 0}


def test_possession_ratio_adds_overlap_and_skips_zero_supply(spark):
    fills = spark.createDataFrame([(1, d("2024-01-01"), 30, True), (1, d("2024-01-10"), 30, True), (1, d("2024-01-12"), 0, True), (1, d("2024-01-15"), 30, False)],
                                  "member_id long, filled_date date, days_supply int, is_statin boolean")
    anchors = spark.createDataFrame([(1, d("2024-03-20"))], "member_id long, event_date date")
    got = lb.possession_ratio(anchors, fills, {"statin": F.col("is_statin")}, (90,)).first()
    assert abs(got["mpr_statin_90d"] - 60 / 90) < 1e-12


def test_month_windows(spark):
    spine = spark.createDataFrame([(1, d("2024-01-01")), (1, d("2024-02-01")), (1, d("2024-04-01")), (2, d("2024-02-01"))], "member_id long, month date")
    facts = spark.createDataFrame([(1, d("2023-12-31"), 2), (1, d("2024-01-15"), 3), (1, d("2024-01-15"), 4), (1, d("2024-02-29"), 5), (3, d("2024-02-01"), 1), (1, None, 7)],
                                  "member_id long, day date, v int")
    always = F.lit(True)
    got = lb.month_windows(spine, [(facts, "day", [
        lb.MonthMeasure({"any_prev": (-1, -1)}, always), lb.MonthMeasure({"n3": (-3, -1), "n_now": (0, 0)}, always, "count"),
        lb.MonthMeasure({"days3": (-2, 0)}, always, "days"), lb.MonthMeasure({"sum2": (-1, 0)}, F.col("v"), "total")])])
    have = table(got, ["member_id", "month"], "any_prev", "n3", "n_now", "days3", "sum2")
    assert have == {
        (1, d("2024-01-01")): (1, 1, 2, 2, 9), (1, d("2024-02-01")): (1, 3, 1, 3, 12),
        (1, d("2024-04-01")): (0, 3, 0, 1, 0), (2, d("2024-02-01")): (0, 0, 0, 0, 0)}


def test_amounts_keep_nine_decimals(spark):
    day = F.lit("2024-01-02").cast("date")
    facts = spark.range(1000).select(F.lit(1).alias("member_id"), day.alias("event_date"), F.lit("0.000040001").cast("decimal(31,9)").alias("v"))
    anchors = spark.range(1).select(F.lit(1).alias("member_id"), F.date_add(day, 3).alias("event_date"))
    for lag in (0, 1):
        at = anchors.withColumn("event_date", F.date_add("event_date", 31 * lag))
        got = lb.day_lookback(at, facts, [lb.Measure("v", F.col("v"))], [lb.DaySpan("90d", 90)], lag_months=lag).first()
        assert got["v_90d"] == Decimal("0.040001000")
    months = anchors.select("member_id", F.lit("2024-01-01").cast("date").alias("month"))
    total = lb.month_windows(months, [(facts, "event_date", [lb.MonthMeasure({"paid": (0, 0)}, F.col("v"), "total")])]).first()
    assert total["paid"] == Decimal("0.040001000")


def test_first_followup(spark):
    schema = "member_id long, event_date date"
    missed = spark.createDataFrame([(1, d("2024-01-01")), (1, d("2024-01-01")), (1, d("2024-01-10")), (2, d("2024-01-01"))], schema)
    ok = spark.createDataFrame([(1, d("2024-01-03")), (1, d("2024-01-13")), (1, d("2023-12-31"))], schema)
    got = table(lb.first_followup(missed, ok, 2), ["member_id", "event_date"], "first_followup")
    assert got == {(1, d("2024-01-01")): d("2024-01-03"), (1, d("2024-01-10")): None, (2, d("2024-01-01")): None}


def test_one_hot_member_gives_one_row_per_day_to_the_window(spark):
    """A member with very many facts reaches the window as its days, not as its facts."""
    facts = spark.range(20000).select(F.lit(1).alias("member_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("event_date"),
                                      F.lit(1.0).alias("v"), F.lit(True).alias("hit"))
    got = lb.day_lookback(lb.member_days(facts), facts, measures(), [lb.DaySpan("5d", 5)])
    assert got.count() == 20 and got.agg(F.max("n_5d")).first()[0] == 5000


def brute_window(facts, anchor, oldest, newest, lag):
    """Sum of (day, value) facts that the anchor sees."""
    import calendar

    month = anchor.year * 12 + anchor.month - 1 - lag
    year, m = divmod(month, 12)
    last = calendar.monthrange(year, m + 1)[1]
    known = anchor.replace(year=year, month=m + 1, day=min(anchor.day, last)) if lag else anchor
    return sum(v for day, v in facts if anchor - dt.timedelta(oldest) <= day <= anchor - dt.timedelta(newest) and day <= known)


@pytest.mark.parametrize("lag", [0, 1, 2, 4])
def test_many_windows_of_any_length_equal_brute_force(spark, lag):
    r = random.Random(lag)
    facts = [(p, dt.date(2023, 1, 1) + dt.timedelta(r.randrange(500)), r.randrange(100)) for p in range(3) for _ in range(90)]
    df = spark.createDataFrame(facts, "member_id long, event_date date, v long")
    spans = [(7, 1), (30, 1), (31, 29), (90, 1), (90, 62), (124, 120), (180, 91), (365, 1)]
    for anchors in (None, lb.member_days(df)):
        got = lb.day_lookback(anchors, df, [lb.Measure("v", F.col("v"), "whole"), lb.Measure("w", F.col("v").cast("decimal(20,9)"))],
                              [lb.DaySpan(f"{a}_{b}", a, b) for a, b in spans], lag_months=lag).collect()
        assert len(got) == len({f[:2] for f in facts})
        for row in got:
            own = [(d, v) for p, d, v in facts if p == row["member_id"]]
            for a, b in spans:
                want = brute_window(own, row["event_date"], a, b, lag)
                assert row[f"v_{a}_{b}"] == want and row[f"w_{a}_{b}"] == want, (row["event_date"], a, b)


def test_facts_are_read_once_whatever_the_windows(spark, fresh_dir):
    spark.range(50).selectExpr("id % 5 AS member_id", "date_add(date'2024-01-01', cast(id AS int)) AS event_date", "id AS v").write.parquet(fresh_dir + "/f")
    facts = spark.read.parquet(fresh_dir + "/f")
    for spans in ([(9, 1)], [(9, 1), (30, 1), (90, 1), (180, 91), (365, 1)]):
        out = lb.day_lookback(None, facts, [lb.Measure("v", F.col("v"), "whole")], [lb.DaySpan(f"{a}_{b}", a, b) for a, b in spans], lag_months=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 2 and plan.count("Generate") == 1
