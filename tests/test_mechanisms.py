"""Sketches, roll-ups, scripts over variables, checks gathered while writing, replies of unknown shape."""

import pytest
from pyspark.sql import functions as F

from memberlens.operators import notes as nt
from memberlens.operators import quality as ql
from memberlens.operators import tabular as tb
from memberlens.sources import tables as src

from tests.helpers import d, rows, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditional_distinct_counts_in_one_scan(spark, fresh_dir):
    data = [(i % 4 if i % 9 else None, i % 7, i % 3, d("2024-01-01") if i % 2 else None) for i in range(200)]
    spark.createDataFrame(data, "g long, a long, b long, t date").write.parquet(fresh_dir + "/f")
    df = spark.read.parquet(fresh_dir + "/f")
    got = tb.conditional_distinct(df, ["g"], {"x": (F.col("b") == 1, F.col("a")), "y": (F.col("b") == 1, F.col("t")), "z": (F.lit(False), F.col("a")), "w": (F.lit(None).cast("boolean"), F.col("a"))})
    assert plan(got).count("FileScan") == 1
    want = {}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g and r[2] == 1]
        want[g] = (len({r[1] for r in own}), len({r[3] for r in own if r[3]}), 0, 0)
    assert table(got, "g", "x", "y", "z", "w") == want
    assert tb.conditional_distinct(df.limit(0), ["g"], {"x": (F.lit(True), F.col("a"))}).count() == 0


def test_merged_sketches_equal_one_sketch(spark):
    df = spark.range(6000).select((F.col("id") % 12).alias("month"), (F.col("id") * 7 % 2500).alias("member"), F.when(F.col("id") < 0, F.col("id")).alias("none"))
    names = ["members", "nobody"]
    monthly = tb.distinct_sketches(df, ["month"], {"members": F.col("member"), "nobody": F.col("none")})
    merged = tb.estimates(tb.merged_sketches(monthly.withColumn("half", F.col("month") % 2), ["half"], names), names)
    for r in merged.collect():
        exact = df.where(F.col("month") % 2 == r["half"]).select("member").distinct().count()
        assert abs(r["members"] - exact) <= 4 * 1.04 / 64 * exact and r["nobody"] == 0
    near = spark.createDataFrame([(100, 100), (120, 100), (1, 0), (3, 0)], "e long, x long").select(tb.within_error(F.col("e"), F.col("x")))
    assert [r[0] for r in near.collect()] == [True, False, True, False]


def test_rolled_up_keeps_null_keys_apart_from_totals(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4), (None, None, 8)], "k string, l string, v int")
    out = tb.rolled_up(df, ["k", "l"], [F.sum("v").alias("v"), F.count("*").alias("n")])
    assert rows(out, "k", "l", "level", "v", "n") == sorted([
        ("a", "x", 0, 1, 1), ("a", "unknown", 0, 2, 1), ("unknown", "x", 0, 4, 1), ("unknown", "unknown", 0, 8, 1),
        ("a", "all", 1, 3, 2), ("unknown", "all", 1, 12, 2), ("all", "all", 2, 15, 4)])
    assert plan(out).count("Exchange hashpartitioning") == 1


def test_scripts_bind_tables_and_values(spark):
    for name, n in (("script_a", 5), ("script_b", 9)):
        spark.range(n).createOrReplaceTempView(name)
    text = "SELECT :label AS label, COUNT(*) AS n, SUM(IDENTIFIER(:column)) AS s FROM IDENTIFIER(:table) WHERE id >= :least"
    trick = "x' ; DROP TABLE script_a; --"
    got = [tuple(src.run_script(spark, text, {"table": t, "column": "id"}, {"label": trick, "least": 2}).first()) for t in ("script_a", "script_b")]
    assert got == [(trick, 3, 9), (trick, 7, 35)]
    assert src.run_script(spark, "SELECT 1 AS one", {}).first()["one"] == 1
    with pytest.raises(Exception):
        src.run_script(spark, text, {"table": "no_such_table", "column": "id"}, {"label": "", "least": 0}).count()


def broken_days(spark):
    data = [(1, d("2024-01-01"), 1), (1, d("2024-01-01"), 0), (1, d("2024-01-01"), 1), (2, d("2024-01-02"), None), (3, d("2030-01-01"), 7), (None, d("2024-01-01"), 0), (None, d("2024-01-01"), 0)]
    return spark.createDataFrame(data, "member_id long, event_date date, y int")


def test_checks_gathered_while_writing_equal_the_suite(spark):
    days = broken_days(spark)
    stage, checks = ql.checked_member_days(days, "days", ["y"], asof="2024-12-31")
    assert rows(checks) == rows(ql.member_day_suite(days, ["y"], asof="2024-12-31"))
    assert rows(stage) == rows(days) and stage.columns == days.columns
    _, clean = ql.checked_member_days(days.where("false"), "none", ["y"], asof="2024-12-31")
    assert {r["n_findings"] for r in clean.collect()} == {0}


def test_checks_run_no_job_of_their_own(spark):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(group, run):
        context.setJobGroup(group, group)
        try:
            run()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    days = broken_days(spark)
    assert jobs("watched", lambda: ql.checked_stage(days, "a", ql.bad_days(["y"]))) == jobs("plain", lambda: src.stored(days, "b"))


def test_items_of_replies_of_unknown_shape(spark):
    replies = [
        (1, '{"category":"a","score":1}', [("ITEMS", 0, "a", 1.0, "BIGINT")]), (2, '[{"category":"a","score":"2"},{"category":"b"},5]', [("ITEMS", 1, "a", 2.0, "STRING"), ("ITEMS", 1, "b", None, "MISSING")]),
        (3, '{"x":{"y":[{"category":"c","score":null}]}}', [("ITEMS", 3, "c", None, "VOID")]), (4, "nonsense {", [("NOT_JSON", None, None, None, None)]), (5, None, [("EMPTY", None, None, None, None)]),
        (6, " ", [("EMPTY", None, None, None, None)]), (7, '{"a":1}', [("NO_ITEMS", None, None, None, None)]), (8, "[]", [("NO_ITEMS", None, None, None, None)]),
        (9, '{"category":"top","score":1.5,"inner":[{"category":"low","score":1}]}', [("ITEMS", 0, "top", 1.5, "DECIMAL(2,1)")]), (10, '[{"category":"t","score":true}]', [("ITEMS", 1, "t", None, "BOOLEAN")]),
        (11, "7", [("NO_ITEMS", None, None, None, None)]),
    ]
    out = nt.variant_items(spark.createDataFrame([r[:2] for r in replies], "id long, raw_response string"), keep=["id"])
    assert rows(out, "id", "kind", "depth", "category", "score", "value_type") == sorted([(i, *item) for i, _, items in replies for item in items], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert nt.variant_items(spark.createDataFrame([], "id long, raw_response string"), keep=["id"]).count() == 0


def test_columns_by_keywords_of_their_descriptions(spark):
    metadata = spark.createDataFrame([("a", "Median income"), ("b", "poverty and income"), ("c", "age"), ("z", "income")], "column_code string, label string")
    assert tb.keyword_directions(metadata, {"poverty": "high", "income": "low"}, ["a", "b", "c"]) == {"a": "low", "b": "high"}
    assert tb.keyword_directions(metadata.limit(0), {"income": "low"}, ["a"]) == {}
