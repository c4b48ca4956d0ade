import datetime as dt

from memberlens.plans import q_months as q
from memberlens.plans import roles as r
from memberlens.plans.registry import Tables
from memberlens.sources import tables as st

from tests.helpers import rows


def day(text):
    return dt.date.fromisoformat(text)


def test_tasks_follow_the_rows_of_the_source(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert st.spread(spark.range(5), "id", spark.range(5)).rdd.getNumPartitions() == few
    assert st.spread(spark.range(5), "id", spark.range(st.TASK_ROWS * (few + 1) + 1)).rdd.getNumPartitions() == few + 2


def test_months_between_orders_come_from_tasks_that_are_not_merged(spark):
    data = [(1, day("2000-11-20")), (1, day("2001-01-05")), (1, day("2001-01-09")), (2, day("2001-03-01")), (3, None), (None, day("2000-05-02"))]
    t = Tables(spark, "/none")
    t._open["orders"] = spark.createDataFrame(data, "member_id long, day date")
    t.stages["order_facts"] = t.orders
    out = r.eligibility(t)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((x.member_id or 0, x.month, x.month_end, x.is_continuously_enrolled) for x in out.collect()), key=lambda x: x[:2])
    assert got == [
        (0, day("2000-05-01"), day("2000-05-31"), False), (1, day("2000-11-01"), day("2000-11-30"), True),
        (1, day("2000-12-01"), day("2000-12-31"), None), (1, day("2001-01-01"), day("2001-01-31"), True),
        (2, day("2001-03-01"), day("2001-03-31"), True)]


def test_blocks_are_written_before_they_are_joined(spark, small_data):
    t = Tables(spark, small_data)
    feeds = q.co_located(t)
    with st.co_partitioned(spark):
        kept = q.kept_blocks(feeds)
        assert kept._jdf.queryExecution().executedPlan().toString().count("Window") == 0
        assert rows(kept) == rows(q.all_blocks(feeds))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
