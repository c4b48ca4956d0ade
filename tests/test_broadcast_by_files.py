"""Stages are not broadcast for the size of their files."""

import pytest

from memberlens.operators import months as mo
from memberlens.plans import q_history as qh
from memberlens.plans import q_months as qm
from memberlens.plans.registry import Tables
from memberlens.sources import tables as st

from tests.helpers import d, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_that_lie_together_are_not_broadcast(spark):
    months = spark.createDataFrame([(m, d(f"2024-{k:02d}-01"), m * k) for m in range(20) for k in range(1, 13)], "member_id long, month date, v long")
    spine, block = (st.bucketed(months.withColumnRenamed("v", n), n, "member_id") for n in ("a", "b"))
    with st.co_partitioned(spark):
        out = mo.star_join(spine, [block])
        assert "Broadcast" not in plan(out) and "Exchange" not in plan(out)
        assert rows(out.select("member_id", "month", "a")) == rows(months) and out.where("a = b").count() == months.count()


@pytest.mark.parametrize("before", [None, "5MB"])
def test_limits_of_broadcasts_come_back(spark, before):
    measured, by_files = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    files = spark.conf.get(by_files)
    if before:
        spark.conf.set(measured, before)
    try:
        with st.co_partitioned(spark):
            assert spark.conf.get(by_files) == "-1" and spark.conf.get(measured) == (before or files)
        assert spark.conf.get(by_files) == files and spark.conf.get(measured, None) == before
    finally:
        spark.conf.unset(measured)


@pytest.mark.parametrize("module, name", [(qh, "k7_chain"), (qm, "k35")])
def test_wide_queries_broadcast_no_stage(spark, small_data, module, name):
    """Plans of the stages that the chain and the wide table write: what lies in files by member is joined there."""
    seen = []

    def noted(write):
        return lambda df, *a, **k: (seen.append(plan(df)), write(df, *a, **k))[1]

    kept = {n: getattr(module, n) for n in ("kept_in_place", "stored")}
    for n, write in kept.items():
        setattr(module, n, noted(write))
    try:
        getattr(module, name)(Tables(spark, small_data))
    finally:
        for n, write in kept.items():
            setattr(module, n, write)
    assert seen and not any("Broadcast" in p for p in seen)
