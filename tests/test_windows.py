import random

import pytest
from pyspark.sql import functions as F

from memberlens.operators import windows as wn
from tests.helpers import d, rows, table

DAYS = [(1, d("2024-01-01"), 0, 1.0), (1, d("2024-01-03"), 1, None), (1, d("2024-01-20"), 0, 3.0), (1, d("2024-03-30"), 1, 5.0), (2, d("2024-01-01"), 1, 2.0)]


@pytest.fixture()
def days(spark):
    return spark.createDataFrame(DAYS, "member_id long, event_date date, f int, v double")


def test_row_and_day_labels_differ(days):
    got = table(days.select("member_id", "event_date", wn.look_ahead("f", 2, "days").alias("by_day"), wn.look_ahead("f", 2, "rows").alias("by_row")),
                ["member_id", "event_date"], "by_day", "by_row")
    assert got[1, d("2024-01-01")] == (1, 1)
    assert got[1, d("2024-01-03")] == (None, 1)
    assert got[1, d("2024-03-30")] == (None, None)
    assert got[2, d("2024-01-01")] == (None, None)


def test_labels_are_zero_filled_only_in_any(days):
    out = wn.with_labels(days.withColumn("any_ed_on_date", F.col("f")).withColumn("any_ip_on_date", F.lit(0)), (30,))
    got = table(out, ["member_id", "event_date"], "y_ed_30d", "y_ip_30d", "y_any_30d")
    assert got[1, d("2024-01-20")] == (None, None, 0) and got[1, d("2024-01-01")] == (1, 0, 1)


def test_delta_days_since_and_newly_positive(days):
    got = table(days.select("member_id", "event_date", wn.delta_to_mean("v", wn.trailing(30, "days")).alias("delta"),
                            wn.days_since_last("v").alias("since"), wn.newly_positive("f", 1).alias("new")), ["member_id", "event_date"], "delta", "since", "new")
    assert got[1, d("2024-01-01")] == (None, None, 0)
    assert got[1, d("2024-01-20")] == (2.0, 19, 0)
    assert got[1, d("2024-01-03")] == (None, 2, 1)
    assert got[1, d("2024-03-30")] == (None, 70, 1)
    assert got[2, d("2024-01-01")] == (None, None, 1)


def test_turns_and_change(days):
    got = table(days.select("member_id", "event_date", wn.turned("f", 0, 1, date="event_date").alias("up"), wn.change("f", date="event_date").alias("diff")),
                ["member_id", "event_date"], "up", "diff")
    assert got[1, d("2024-01-03")] == (1, 1) and got[1, d("2024-01-20")] == (0, -1) and got[2, d("2024-01-01")] == (0, None)


def test_group_means_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, v double")
    got = rows(wn.with_group_means(df, "v", {"m": ["g"]}), "g", "v", "m")
    assert got == [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, None), (None, 5.0, 5.0)]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [1, 7, 50])
def test_running_totals(spark, descending, buckets):
    rng = random.Random(5)
    values = sorted({round(rng.random() ** 4, 6) for _ in range(400)})
    data = [(v, rng.randrange(10)) for v in values]
    got = table(wn.running_totals(spark.createDataFrame(data, "s double, n int"), "s", ["n"], descending, buckets), "s", "cum_n")
    total, want = 0, {}
    for v, n in sorted(data, reverse=descending):
        total += n
        want[v] = total
    assert got == want


def test_running_totals_per_group(spark):
    data = [(g, float(i), i) for g in "ab" for i in range(50)]
    got = table(wn.running_totals(spark.createDataFrame(data, "g string, s double, n int"), "s", ["n"], buckets=5, by=["g"]), ["g", "s"], "cum_n")
    assert all(got[g, float(i)] == i * (i + 1) // 2 for g in "ab" for i in range(50))


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (5.0,)], "v double")
    assert rows(wn.cumulative_share(df, "v", 3), "v", "n", "cume_dist") == [(1.0, 2, 0.5), (2.0, 1, 0.75), (5.0, 1, 1.0)]


def test_top_per_group_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 9, 1)], "g string, id int, n int")
    assert rows(wn.top_per_group(df, ["g"], [F.desc("n"), F.asc("id")], 2), "g", "id", "rn") == [("a", 1, 1), ("a", 2, 2), ("b", 9, 1)]


def test_thousands_of_ranges_need_no_limit(spark):
    values = random.Random(2).sample(range(10**6), 12_000)
    df = spark.createDataFrame([(float(v), 1) for v in values], "s double, one long")
    assert len(wn.range_buckets(df, "s", 10_000)) > 9_000
    for descending in (False, True):
        got = table(wn.running_totals(df, "s", ["one"], descending, buckets=10_000), "s", "cum_one")
        assert got == {float(v): i for i, v in enumerate(sorted(values, reverse=descending), 1)}


def test_offsets_of_ranges_of_ranges(spark):
    totals = spark.createDataFrame([(g, float(b), b % 5) for g in "xy" for b in range(100)], "g string, b double, v long")
    for descending in (False, True):
        got = table(wn.range_offsets(totals, "b", ["v"], 100, descending, ["g"], width=3), ["g", "b"], "_before_v")
        assert got == {(g, float(b)): sum(x % 5 for x in range(100) if (x > b if descending else x < b)) for g in "xy" for b in range(100)}


def test_rows_of_one_value_lie_in_several_ranges(spark):
    rows_ = [(g, 5 if i % 7 else 9, i) for g in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows_, "g string, n long, t long").repartition(5)
    got = table(wn.ranked_in_groups(df, ["g"], "n", ["t"], "rn"), ["g", "t"], "rn")
    want = {(g, t): i for g in ("a", None) for i, (_, _, t) in enumerate(sorted((r for r in rows_ if r[0] == g), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want
