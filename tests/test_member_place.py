import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memberlens.operators import clinical as cl
from memberlens.plans import q_months as q
from memberlens.plans.catalogue import QUERIES
from memberlens.plans.registry import Tables
from memberlens.sources import tables as st

from tests.helpers import rows


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


@pytest.mark.parametrize("name", ["k29_pharmacy_months", "k29_pharmacy_months_by_date"])
def test_fills_meet_the_spine_where_it_lies(spark, small_data, name):
    lines = plan_lines(QUERIES[name](spark, small_data))
    assert any("Union" in x for x in lines)
    assert not any("Exchange" in lines[i - 1] for i, x in enumerate(lines) if "Union" in x)


def month(day):
    return day.year * 12 + day.month


def by_hand(spine, fills, mode):
    """Every spine month looks at every distinct fill of its member."""
    out = []
    for member, m in spine:
        own = [(ndc, day, supply) for who, ndc, day, supply in set(fills) if who == member]
        near = [x for x in own if month(m) - 2 <= month(x[1]) and (month(x[1]) <= month(m) if mode == "month" else x[1] <= m)]
        counted = [x for x in own if mode == "month" or x[1].day == 1]
        ever = any(month(x[1]) <= month(m) if mode == "month" else x[1] <= m for x in own)
        firsts = {ndc: min(x[1] for x in own if x[0] == ndc) for ndc, _, _ in own}
        mpr = sum(x[2] or 0 for x in near) / 90
        refilled = [any(month(x[1]) == month(m) - back for x in counted) for back in (0, 1)]
        out.append((member, m, int(ever), len({x[0] for x in near}), mpr if ever else None, (int(mpr >= 0.8)) if ever else None,
                    int(refilled[1] and not refilled[0]), int(any(month(x[1]) == month(m) and firsts[x[0]] == x[1] for x in counted))))
    return sorted(out)


@pytest.mark.parametrize("mode", ["month", "date"])
def test_pharmacy_months_equal_all_pairs(spark, mode):
    draw = random.Random(7)
    days = [dt.date(2024, m, d) for m in range(1, 13) for d in (1, 1, 2, 28)]
    fills = [(draw.randrange(8), draw.randrange(3), draw.choice(days), draw.choice([10, 30, 30, None])) for _ in range(150)]
    fills += fills[:30]
    spine = [(member, dt.date(2024, m, 1)) for member in range(9) for m in range(2, 12) if (member, m) != (3, 6)]
    facts = spark.createDataFrame(fills, "member_id long, ndc long, filled_date date, days_supply int")
    got = cl.pharmacy_months(spark.createDataFrame(spine, "member_id long, month date"), facts, {"all": F.lit(True), "none": F.lit(False)}, mode)
    assert sorted(tuple(x)[:8] for x in got.collect()) == by_hand(spine, fills, mode)
    assert {x[2:] for x in rows(got.select("member_id", "month", *[c for c in got.columns if "none" in c]))} == {(0, 0, None, None, 0, 0)}


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["k22_engagement_trends", "k23_engagement_flags"])
def test_blocks_are_joined_where_the_spine_lies(spark, small_data, no_broadcast, monkeypatch, name):
    plans = []
    monkeypatch.setattr(q, "stored", lambda df, name: plans.append(plan_lines(df)) or df)
    df = QUERIES[name](spark, small_data)
    lines = [*plans, plan_lines(df)][0]
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange" in x]
    # one union has its rows shuffled: the person-days of the follow-up search
    assert sum("Union" in x for x in lines) == 4 and sum("Union" in x for x in below) == 1
    assert not any("Window" in x or "Join" in x for x in below)
    assert all("HashAggregate" in lines[i + 1] for i, x in enumerate(lines) if "Exchange" in x and ", month#" in x)


@pytest.mark.parametrize("name, table", [("k22_engagement_trends", q.trends), ("k23_engagement_flags", q.flags)])
def test_placed_blocks_have_the_same_rows(spark, small_data, name, table):
    assert rows(QUERIES[name](spark, small_data)) == rows(table(Tables(spark, small_data)))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_rows_of_a_task_may_be_chosen(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert st.spread(spark.range(5), "id", spark.range(10 * few + 11), 10).rdd.getNumPartitions() == few + 2
