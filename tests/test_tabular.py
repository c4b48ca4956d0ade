from pyspark.sql import functions as F

from memberlens.operators import cohort as co
from memberlens.operators import quality as ql
from memberlens.operators import tabular as tb
from tests.helpers import d, rows, table


def test_full_outer_and_exists(spark):
    a = spark.createDataFrame([(1, 5), (2, None)], "k int, a int")
    b = spark.createDataFrame([(2, 7), (3, 8)], "k int, b int")
    assert rows(tb.full_outer(a, b, ["k"])) == [(1, 5, 0), (2, 0, 7), (3, 0, 8)]
    twice = b.union(b)
    assert rows(tb.exists_flag(a, twice, ["k"], "has"), "k", "has") == [(1, 0), (2, 1)]


def test_anti_join_survives_null_in_the_list(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(tb.without(df, spark.createDataFrame([(2,), (None,)], "k int"), "k")) == [(1,)]


def test_code_join_does_not_multiply(spark):
    facts = spark.createDataFrame([("E11.9",), ("q",), (None,)], "c string")
    dim = spark.createDataFrame([("E119", "new", 1), ("e11.9", "new", 1), ("E119", "old", 2)], "code string, v string, g int")
    assert rows(tb.code_join(facts, "c", dim, "code", ["g"], F.col("v") == "new"), "c", "g") == [("E11.9", 1), ("q", None), (None, None)]


def test_duplicates_shares_and_rates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "member_id int, g string")
    assert rows(tb.duplicate_keys(df, ["member_id", "g"]), "member_id", "record_count") == [(1, 2), (2, 2)]
    assert tb.repeated_rows(df, ["member_id", "g"]).first() == (5, 3, 2)
    assert table(tb.share_of_total(df, ["g"]), "g", "share") == {"a": 0.4, None: 0.4, "b": 0.2}
    rates = table(tb.rates_per_thousand(df, {"a": F.col("g") == "a"}), "label", "rate_per_1000_members")
    assert abs(rates["a"] - 1000 / 3) < 1e-9


def test_texts_and_maps(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None)], "k int, t string")
    assert tb.ordered_text(df, ["k"], "t", "x").first()["x"] == " a b b"
    assert tb.ordered_text(df, ["k"], "t", "x", unique=True).first()["x"] == " a b"
    pairs = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, key string, v int")
    assert tb.as_map(pairs, ["k"], "key", "v", "m").first()["m"] == {"a": 1, "b": 2}


def test_outliers_and_latest(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 9.0, 1.0), ("d", None, -9.0)], "area string, hi double, lo double")
    got = table(tb.outlier_flags(df, {"hi": "high", "lo": "low"}, "area"), "area", "hi_outlier", "lo_outlier")
    assert got == {"a": (0, 0), "b": (0, 0), "c": (1, 0), "d": (0, 1)}
    assert rows(tb.latest_periods(df.select("area"), "area", 2)) == [("c",), ("d",)]


def test_yearly_summary(spark):
    df = spark.createDataFrame([(1, 1, d("2024-01-01"), 10), (1, 1, d("2024-01-01"), 5), (1, 2, d("2024-05-01"), 5), (2, 3, d("2024-05-01"), 0), (2, 4, d("2025-05-01"), 4)],
                               "member_id int, claim_id int, service_date date, paid_amount int")
    got = table(tb.yearly_summary(df), "year", "members", "claims", "lines", "mean_member_total")
    assert got == {2024: (2, 3, 4, 10.0), 2025: (1, 1, 1, 4.0)}


def test_top_codes(spark):
    data = [(1, "a", "A", "23")] * 3 + [(2, "b", "B", "23")] * 2 + [(3, "c", "C", "21")] + [(None, "z", "Z", "21")] * 9 + [(1, "aa", "A2", "21")]
    df = spark.createDataFrame(data, "hcc_code int, icd_code string, icd_desc string, place string")
    got = rows(tb.top_codes(df, {"ED": F.col("place") == "23", "IP": F.col("place") == "21"}, 1), "hcc_code", "icd_code", "icd_count")
    assert got == [(1, "a", 3)]
    assert rows(tb.categories_by_description(df, "a2")) == [(1,)]


def test_cohort_tools(spark):
    df = spark.createDataFrame([(i, 1 if i % 7 else None) for i in range(300)], "member_id long, y int")
    split = co.labelled_split(df, "y")
    assert split.where("y IS NULL").count() == 0
    sizes = table(split.groupBy("split").count(), "split", "count")
    assert set(sizes) == {"train", "val", "test"} and sizes["train"] > sizes["val"]
    assert ql.split_leaks(split.union(split), split="split").count() == 0
    again = co.member_split(df, {"a": 0.5, "b": 0.5}, seed="s")
    assert rows(again) == rows(co.member_split(df, {"a": 0.5, "b": 0.5}, seed="s"))
    log = spark.createDataFrame([(1, "Phone Call", "individual"), (1, "INCOMING", "individual"), (1, "fax", "individual"), (1, "incoming", "x")], "member_id int, direction string, party string")
    got = rows(co.channel_split(log, F.col("party") == "individual", {"phone": ["phone call"], "sms": ["incoming", "outgoing"]}), "channel")
    assert got == [("phone",), ("sms",)]


def test_enrolment_status_order(spark):
    df = spark.createDataFrame([("x SUSPENDED", True, True, "m"), ("a", True, True, "m"), ("a", False, True, "m"), ("a", False, False, None), ("a", False, False, "m"), ("a", None, None, None)],
                               "current_status string, has_ever_been_engaged boolean, is_batched boolean, market string")
    assert [r[0] for r in df.select(co.enrolment_status()).collect()] == ["DISENROLLED", "ENGAGED", "BATCHED", "UNSERVED GEO", "NOT SELECTED", None]


def test_reconciliation(spark):
    feeds = spark.createDataFrame([(1, d("2024-01-05"), "a"), (1, d("2024-01-05"), "b"), (1, d("2024-01-05"), "a"), (1, d("2024-01-09"), "b"), (1, None, "a")], "member_id int, admit_date date, source_type string")
    rec = co.reconcile_encounters(feeds, {"in_a": "a", "in_b": "b"})
    assert rows(rec, "admit_date", "in_a", "in_b") == [(d("2024-01-05"), 1, 1), (d("2024-01-09"), 0, 1)]
    assert rows(co.encounter_months(rec, ["in_a", "in_b"]), "num_admissions", "count_in_a", "count_in_b") == [(2, 1, 2)]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, d("2024-01-01"), 0, 1, 0), (1, d("2024-01-01"), 2, 1, 1), (None, d("2030-01-01"), None, 1, 0)], "member_id int, event_date date, y int, a int, b int")
    assert table(ql.null_counts(df, ["member_id", "y"]), "column_name", "null_count") == {"member_id": 1, "y": 1}
    assert table(ql.invalid_values(df, ["y"]), "column_name", "invalid_count") == {"y": 1}
    assert table(ql.one_hot_breaches(df, {"ab": ["a", "b"]}), "rule", "invalid_record_count") == {"ab": 1}
    assert table(ql.constant_features(df, ["a", "b"]), "column_name", "is_constant") == {"a": True, "b": False}
    suite = table(ql.member_day_suite(df, ["y"], asof="2024-12-31"), "check", "status", "n_findings")
    assert suite == {"null_keys": ("ISSUES FOUND", 1), "null_labels": ("ISSUES FOUND", 1), "invalid_labels": ("ISSUES FOUND", 1),
                     "future_dates": ("ISSUES FOUND", 1), "duplicate_keys": ("ISSUES FOUND", 1)}
    clean = table(ql.member_day_suite(df.where("y = 0"), ["y"]), "check", "status")
    assert set(clean.values()) == {"OK"}
    info = ql.run_suite([ql.Check("seen", df, informational=True)]).first()
    assert (info["status"], info["n_findings"]) == ("INFO", 3)
    assert ql.positive_days(df, ["a"]).first() == (2, 2)
