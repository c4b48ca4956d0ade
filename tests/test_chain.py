import pytest
from pyspark.sql import functions as F

from memberlens.operators import daily as dy
from memberlens.operators import lookback as lb
from memberlens.operators import months as mo
from memberlens.plans import q_history as q
from memberlens.plans import roles as r
from memberlens.plans.registry import Tables
from memberlens.sources import tables as st

from tests.helpers import d, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_log_by_member_is_looked_back_on_where_it_lies(spark):
    log = spark.createDataFrame([
        (1, d("2024-01-05"), "CLAIM_REVENUE", True, False), (1, d("2024-01-05"), "ADT", True, True), (1, d("2024-02-05"), "CARE_NOTE", True, None),
        (2, d("2024-01-09"), "ADT", None, True), (2, d("2024-03-01"), "CARE_NOTE", False, True), (2, d("2024-03-02"), None, True, True)],
        "member_id long, event_date date, event_type string, is_ed_adt boolean, is_ip_adt boolean")
    log = log.withColumns({n: F.lit(False) for n in ("is_ip_auth", "is_ed_auth", "is_ip_hc", "is_ed_hc")})
    kept = st.bucketed(log, "log", "member_id")
    with st.co_partitioned(spark):
        got = dy.realtime_lookback(None, kept, ["ADT"])
        assert "Exchange" not in plan(got)
        assert rows(got) == rows(dy.realtime_lookback(lb.member_days(log), log.where("event_type = 'ADT'")))
        # only the admission of member 1 counts, not the claim and the note with the same flag
        assert rows(got.where("member_id = 1"), "event_date", "cnt_ed_adt_90d") == [(d("2024-01-05"), 0), (d("2024-02-05"), 1)]


def test_the_log_is_written_without_moving_claim_lines(spark, small_data):
    t = Tables(spark, small_data)
    seen, kept = [], q.kept_in_place
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    q.kept_in_place = lambda df, *a, **k: (seen.append(plan(df)), kept(df, *a, **k))[1]
    try:
        with q.chained(t):
            s = r.member_lines(t, lambda parts: q.ev.mapped_diagnoses(parts, r.code_map(t)))
            log = q.located_log(t, s)
    finally:
        q.kept_in_place = kept
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert seen[0].count("Exchange") == 2 and seen[0].count("REPARTITION_BY_NUM") == 2  # the two small feeds
    assert rows(log) == rows(q.full_log(t))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_settings_come_back(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.codegen.maxFields")
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ValueError):
        with st.shuffled_by_rows(spark.range(1000), 10), st.wide_rows(spark, 7):
            assert [spark.conf.get(n) for n in names] == ["100", "7"]
            raise ValueError
    assert [spark.conf.get(n) for n in names] == before


def test_labels_need_no_reduction_of_months(spark):
    months = spark.createDataFrame([
        (1, d("2024-01-01"), 0, 1), (1, d("2024-02-01"), 2, 0), (1, d("2024-04-01"), 0, 3), (1, None, 5, 5), (None, d("2024-01-01"), 1, 0),
        (1, d("2024-02-01"), 2, 0)], "member_id long, month date, ed_events_in_month long, ip_events_in_month long")
    enrolled = spark.createDataFrame([(1, d("2024-04-01"), 1), (1, d("2024-05-01"), 0), (1, None, 1)], "member_id long, month date, is_enrolled int")
    out = mo.month_labels(months, enrolled)
    assert "Aggregate" not in plan(out)
    got = rows(out, "member_id", "month", "ed_event_next_30d", "ed_event_next_60d", "ip_event_next_60d", "ip_event_next_90d", "is_active_next_90d")
    none = (0,) * 5
    assert got == sorted([
        (1, d("2024-01-01"), 1, 1, 0, 1, 1), (1, d("2024-02-01"), 0, 0, 1, 1, 0), (1, d("2024-02-01"), 0, 0, 1, 1, 0), (1, d("2024-04-01"), *none),
        (1, None, *none), (None, d("2024-01-01"), *none)], key=lambda x: tuple((v is None, str(v)) for v in x))
