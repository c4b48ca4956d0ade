import pytest
from pyspark.sql import functions as F

from memberlens.plans import q_months as q
from memberlens.plans.catalogue import QUERIES
from memberlens.plans.registry import ORACLES, Tables
from memberlens.sources.tables import bucketed, co_partitioned

from tests.helpers import rows


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_rows_are_grouped_and_joined_where_they_lie(spark, no_broadcast):
    a = bucketed(spark.createDataFrame([(i % 7, i) for i in range(60)], "k long, v long"), "a-b", "k")
    b = bucketed(spark.createDataFrame([(i % 9, i) for i in range(30)], "k long, w long"), "b", "k")
    with co_partitioned(spark):
        joined = a.groupBy("k", "v").agg(F.count("*").alias("n")).join(b, [a["k"] == b["k"], a["v"] == b["w"]]).select(a["k"], "v", "n")
        assert not any("Exchange" in x for x in plan_lines(joined))
        assert rows(joined) == rows(spark.createDataFrame([(i % 7, i, 1) for i in range(30) if i % 7 == i % 9], "k long, v long, n long"))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def scans(spark, build):
    """Input paths of all files scanned by the writes that ``build`` starts, and its result."""
    seen = []
    writer = type(spark.range(1).write)
    kept = {name: getattr(writer, name) for name in ("parquet", "saveAsTable")}

    def watched(name):
        def run(self, *args, **kwargs):
            seen.extend(x for x in plan_lines(self._df) if "Scan parquet" in x)
            return kept[name](self, *args, **kwargs)
        return run

    for name in kept:
        setattr(writer, name, watched(name))
    try:
        return seen, build()
    finally:
        for name, fn in kept.items():
            setattr(writer, name, fn)


def test_the_wide_table_joins_without_exchange_and_reads_facts_at_most_twice(spark, small_data, no_broadcast):
    t = Tables(spark, small_data)
    seen, feeds = scans(spark, lambda: q.co_located(t))
    with co_partitioned(spark):
        lines = plan_lines(q.all_blocks(feeds))
    seen += [x for x in lines if "Scan parquet" in x]
    assert 1 <= sum("l_shipdate" in x for x in seen) <= 2 and 1 <= sum("o_orderkey" in x for x in seen) <= 2
    moved = [i for i, x in enumerate(lines) if "Exchange" in x]
    # what moves are person-months that meet the spine in one window; no join has an exchange below it
    assert moved and all("Union" in lines[i + 1] for i in moved) and sum("SortMergeJoin" in x for x in lines) > 20


def test_only_the_named_feeds_are_written(spark, small_data):
    feeds = q.co_located(Tables(spark, small_data), q.MAIN_FEEDS)
    assert set(feeds.stages) == {"order_facts", "members", "eligibility", "claims", "member_months"}


def test_counts_survive_the_reduction(spark, small_data):
    t = Tables(spark, small_data)
    feeds = q.co_located(t)
    for block in (q.contact, q.sms, q.phone, q.k24, q.k30, q.k31):
        assert rows(block(feeds)) == rows(block(t)), block
    assert "k35_all_blocks" in ORACLES


@pytest.mark.parametrize("name", ["k1_event_log", "k2_diagnosis_rollup", "k5_day_labels_30_60_90", "k4_signal_of_log"])
def test_claim_lines_are_read_once(spark, small_data, no_broadcast, name):
    seen, df = scans(spark, lambda: QUERIES[name](spark, small_data))
    seen += [x for x in plan_lines(df) if "Scan parquet" in x]
    assert sum("l_shipdate" in x for x in seen) == 1 and sum("o_custkey" in x for x in seen) == 1


def test_member_days_come_from_one_reduction_of_the_feed(spark, small_data, no_broadcast):
    lines = plan_lines(QUERIES["k11_member_day_table"](spark, small_data))
    assert sum("event_type" in x for x in lines if "Scan parquet" in x) == 1
