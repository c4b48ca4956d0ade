"""Lookbacks that share one sorted pass, against the single ones."""

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from memberlens.operators import eventlog as ev
from memberlens.operators import lookback as lb
from memberlens.plans import stages

from tests.helpers import d, rows

SCHEMA = "member_id long, event_date date, amount decimal(18,2), hit boolean, n int"


def facts(spark):
    ends = [date(y, m, 1) - timedelta(n) for y in (2023, 2024, 2025) for m in range(1, 13) for n in (0, 1, 2, 3)]
    made = [(1 + i % 2, day, None if i % 7 == 0 else f"{i}.25", None if i % 5 == 0 else i % 3 == 0, i) for i, day in enumerate(ends)]
    return spark.createDataFrame([(m, day, a and Decimal(a), h, n) for m, day, a, h, n in made] + [
        (1, ends[9], None, True, 1), (1, ends[9], None, True, None), (None, ends[3], None, True, 1), (2, None, None, True, 1)], SCHEMA)


def blocks():
    spans = [lb.DaySpan("90d", 90), lb.DaySpan("180d", 180), lb.DaySpan("90_180d", 180, 91), lb.DaySpan("121d", 121), lb.DaySpan("late", 122, 122)]
    return [
        lb.DayBlock([lb.Measure(f"{p}_amount", F.col("amount")), lb.Measure(f"{p}_days", F.col("hit"), "days"),
                     lb.Measure(f"{p}_rows", F.col("hit"), "count"), lb.Measure(f"{p}_n", F.col("n"), "whole")], spans, lag)
        for p, lag in (("a", 4), ("b", 2), ("c", 0), ("d", 13))]


def test_one_pass_gives_what_each_lookback_gives(spark):
    df = facts(spark)
    got = lb.day_lookbacks(df, blocks(), {"most": F.max("n")})
    assert got.count() == df.where("member_id is not null and event_date is not null").select("member_id", "event_date").distinct().count()
    for b in blocks():
        one = lb.day_lookback(None, df, b.measures, b.spans, lag_months=b.lag_months)
        assert dict(one.dtypes) == {c: t for c, t in got.dtypes if c in one.columns}
        assert rows(got.select(*one.columns)) == rows(one)
    most = df.groupBy("member_id", "event_date").agg(F.max("n").alias("most")).where("member_id is not null and event_date is not null")
    assert rows(got.select("member_id", "event_date", "most")) == rows(most)


def test_one_pass_sorts_once_and_adds_no_rows(spark):
    got = lb.day_lookbacks(facts(spark), blocks()[:3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Generate" not in plan and "Join" not in plan


def test_distances_of_a_lag():
    assert lb.lag_distances(4) == (120, 121, 122, 123) and lb.lag_distances(1) == (28, 29, 30, 31)
    assert lb.lag_distances(2)[0] == 59 and lb.lag_distances(2)[-1] == 62 and lb.lag_distances(12) == (365, 366)


def test_member_days_read_the_log_once(spark):
    """All blocks of the chain from one reduction of the log, with the supply of its own fills or of fills beside it."""
    fills = spark.createDataFrame([(1, d("2024-01-05"), "x", 30, True), (1, d("2024-03-20"), "x", 20, True), (2, d("2024-03-01"), "y", 0, True)],
                                  "member_id long, filled_date date, ndc string, days_supply int, is_statin boolean")
    for c in stages.codes.DAILY_DRUG_CLASSES:
        fills = fills if c == "statin" else fills.withColumn(f"is_{c}", F.lit(False))
    feed = spark.createDataFrame([(1, d("2024-03-25"), "ED"), (1, d("2024-05-01"), "IP"), (2, d("2024-03-01"), "ED")], "member_id long, admit_date date, setting string")
    members = spark.createDataFrame([(1, "m"), (2, "n")], "member_id long, market string")

    def log(extra):
        return ev.event_log([ev.fill_events(fills), ev.admission_events(feed, "ADT", "adt")], extra=extra)

    own, beside = stages.member_days(log([ev.SUPPLY]), None, members), stages.member_days(log([]), fills, members)
    names = ["member_id", "event_date", "mpr_statin_90d", "mpr_statin_180d", "cnt_fills_statin_180d", "cnt_ed_visits_180d", "y_ip_60d", "market"]
    assert rows(own.select(*names)) == rows(beside.select(*names))
    assert sorted(own.columns) == sorted(beside.columns)
    last = own.where("member_id = 1 and event_date = '2024-05-01'").first()
    assert (last["mpr_statin_180d"], last["cnt_fills_statin_180d"], last["cnt_ed_visits_180d"]) == (30 / 180, 1, 1)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # the members
