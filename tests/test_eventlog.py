from pyspark.sql import functions as F

from memberlens.operators import daily as dy
from memberlens.operators import eventlog as ev
from tests.helpers import d, rows, table

LINE = ("member_id long, claim_id long, claim_line_number int, service_date date, service_end_date date, place_of_service string, "
        "revenue_code string, hcpcs_code string, paid_amount decimal(18,2)")


def lines(spark):
    from decimal import Decimal
    return spark.createDataFrame([
        (1, 10, 1, d("2024-01-05"), None, "23", "0450", "G1", Decimal("10.00")),
        (1, 10, 2, None, d("2024-01-06"), "11", None, None, Decimal("5.00")),
        (1, 10, 1, d("2024-01-05"), None, "23", "0450", "G1", Decimal("10.00")),
        (2, 11, 1, d("2024-01-07"), None, "21", "0300", "9X", Decimal("7.00")),
    ], LINE)


def mapped(spark):
    dx = spark.createDataFrame([(1, 10, 1, "E11.9"), (1, 10, 2, "i50"), (2, 11, 1, "Z99"), (2, 11, 2, None)],
                               "member_id long, claim_id long, dx_line_number int, icd_code string")
    code_map = spark.createDataFrame([("E119", "CMS-HCC-V28", 2024, 37), ("E11.9", "CMS-HCC-V24", 2023, 19), ("I50", "CMS-HCC-V28", 2024, 226), ("E119", "CMS-HCC-V28", 2024, 37)],
                                     "diagnosis_code string, model_version string, payment_year int, hcc_code int")
    return ev.mapped_diagnoses(dx, code_map)


def test_mapping_keeps_one_row_per_diagnosis(spark):
    got = rows(mapped(spark), "claim_id", "icd_code", "hcc_code")
    assert got == sorted([(10, "E11.9", 37), (10, "i50", 226), (11, "Z99", None), (11, None, None)], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_diagnosis_events_once_per_distinct_line(spark):
    got = rows(ev.diagnosis_events(lines(spark), mapped(spark)), "claim_id", "claim_line_number", "event_date", "cnt_hcc_diabetes", "has_chf", "hcc_category", "is_ed_event")
    assert got == [(10, 1, d("2024-01-05"), 1, 1, 226, True), (10, 2, d("2024-01-06"), 1, 1, 226, False), (11, 1, d("2024-01-07"), 0, 0, None, False)]


def test_line_events_keep_repeats(spark):
    kinds = spark.createDataFrame([("g1", "Visit", "psychotherapy")], "hcpcs_code string, hcpcs_category string, hcpcs_category_short string")
    got = rows(ev.line_events(lines(spark), kinds), "event_type", "claim_id", "code", "code_family", "hcpcs_category_short")
    assert got == [("CLAIM_PROCEDURE", 10, "G1", "G", "psychotherapy"), ("CLAIM_PROCEDURE", 10, "G1", "G", "psychotherapy"), ("CLAIM_PROCEDURE", 11, "9X", None, None),
                   ("CLAIM_REVENUE", 10, "0450", "045", None), ("CLAIM_REVENUE", 10, "0450", "045", None), ("CLAIM_REVENUE", 11, "0300", "030", None)]


def feeds(spark):
    adt = spark.createDataFrame([(1, d("2024-01-05"), "Emergency"), (3, d("2024-01-09"), "INPATIENT"), (3, None, "ed")], "member_id long, admit_date date, setting string")
    fills = spark.createDataFrame([(1, d("2024-01-05"), 30, "", "77", True), (1, d("2024-01-06"), 0, "x", "y", True)],
                                  "member_id long, filled_date date, days_supply int, ndc11 string, ndc string, is_insulin boolean")
    fills = fills.withColumns({f"is_{c}": F.lit(None).cast("boolean") for c in ("antipsychotic", "oral_antidiab", "statin", "beta_blocker", "opioid")})
    notes = spark.createDataFrame([(1, d("2024-01-05"), " health ", 4)], "member_id long, note_date date, category string, score long")
    return [ev.admission_events(adt, "ADT", "adt"), ev.fill_events(fills, ["ndc11", "ndc"]), ev.note_events(notes),
            ev.diagnosis_events(lines(spark), mapped(spark)), ev.line_events(lines(spark))]


def test_log_has_the_common_shape(spark):
    log = ev.event_log(feeds(spark))
    assert log.schema == ev.EVENT_SCHEMA or [f.name for f in log.schema] == [f.name for f in ev.EVENT_SCHEMA]
    assert len(ev.EVENT_SCHEMA) == 51
    got = table(log.groupBy("event_type").agg(F.count("*").alias("n"), F.max("code").alias("code")), "event_type", "n", "code")
    assert got == {"ADT": (2, "INPATIENT"), "PHARMACY_FILL": (1, "77"), "CARE_NOTE": (1, "HEALTH"), "CLAIM_DIAGNOSIS": (3, None),
                   "CLAIM_REVENUE": (3, "0450"), "CLAIM_PROCEDURE": (3, "G1")}


def test_log_restricted_to_members(spark):
    members = spark.createDataFrame([(3,)], "member_id long")
    assert ev.event_log(feeds(spark), members).select("member_id").distinct().collect()[0][0] == 3


def test_signals_agree_joined_or_in_one_pass(spark):
    log = ev.event_log(feeds(spark))
    one = ev.combined_signal(log)
    two = ev.joined_signals(ev.daily_signal(log), ev.diagnosis_signal(log)).select(*one.columns)
    assert rows(one) == rows(two)
    got = table(one, ["member_id", "event_date"], "any_ed_on_date", "any_ip_on_date", "is_ed_adt", "has_diabetes", "has_chf")
    assert got[1, d("2024-01-05")] == (1, 0, 1, 1, 1) and got[3, d("2024-01-09")] == (0, 1, 0, 0, 0)


def test_labels_and_themes(spark):
    got = table(ev.day_labels(ev.combined_signal(ev.event_log(feeds(spark))), (30,)), ["member_id", "event_date"], "y_any_30d", "y_chf_day", "y_diabetes_day")
    assert got[1, d("2024-01-05")] == (0, 1, 1) and got[1, d("2024-01-06")] == (0, 0, 0)


def test_cohort_rules(spark):
    members = spark.createDataFrame([
        (1, "m", " abd w/smi ", True, None, d("2024-01-31")), (2, None, "x", True, True, None), (3, "m", "exclude", True, True, None),
        (4, "m", None, True, True, None), (5, "m", "tanf", False, True, d("2024-03-01")), (6, "m", "tanf", False, False, None)],
        "member_id long, market string, coverage string, has_ever_been_engaged boolean, is_batched boolean, first_selected_date date")
    qualified = spark.createDataFrame([(i, 1 if i < 6 else 0) for i in range(1, 7)], "member_id long, is_qualified int")
    got = rows(ev.cohort(members, qualified, F.lit("2024-03-15").cast("date")), "member_id", "normalized_coverage", "engagement_group", "months_since_batched")
    assert got == [(1, "ABD", "engaged_in_program", 2), (5, "TANF", "selected_not_engaged", 0)]


def test_member_day_assembly(spark):
    k = "member_id long, event_date date"
    features = spark.createDataFrame([(1, d("2024-01-01"), 3), (1, d("2024-01-02"), 4), (9, d("2024-01-01"), 5)], k + ", x int")
    labels = spark.createDataFrame([(1, d("2024-01-01"), 1)], k + ", y_ed_30d int")
    members = spark.createDataFrame([(1, "m")], "member_id long, market string")
    block = spark.createDataFrame([(1, d("2024-01-02"), 7)], k + ", b int")
    got = rows(dy.member_day_table(features, members, labels, [block]), "event_date", "x", "b", "market", "y_ed_30d")
    assert got == [(d("2024-01-01"), 3, None, "m", 1), (d("2024-01-02"), 4, 7, "m", 0)]


def test_daily_pieces(spark):
    scores = spark.createDataFrame([(1, d("2024-01-01"), "HEALTH", 2), (1, d("2024-01-01"), "HEALTH", 4), (1, d("2024-01-01"), "OTHER", 9)], "member_id long, event_date date, category string, score long")
    assert rows(dy.note_pivot(scores), "note_health_score", "note_self_score") == [(4, None)]
    days = spark.createDataFrame([(1, d("2024-01-31"), 0, None), (1, d("2024-02-01"), 2, 3), (2, d("2024-01-01"), 0, None)], "member_id long, event_date date, c int, s int")
    got = table(dy.months_since_first(days, {"c": "c"}), ["member_id", "event_date"], "months_since_first_c")
    assert got == {(1, d("2024-01-31")): -1, (1, d("2024-02-01")): 0, (2, d("2024-01-01")): None}
    flags = table(dy.with_intervention_period(days, "s", F.col("member_id") == 1), ["member_id", "event_date"], "has_care_notes_post_period")
    assert flags == {(1, d("2024-01-31")): 0, (1, d("2024-02-01")): 1, (2, d("2024-01-01")): 0}
    snap = spark.createDataFrame([(1, 2025, 2.5)], "member_id long, payment_year int, raf double")
    assert rows(dy.with_snapshot(days, snap, ["raf"]), "member_id", "raf") == [(1, 2.5), (1, 2.5), (2, 1.5)]
    noisy = dy.with_inconsistency(days, {"bad": F.col("c") > 1}, 60, "rows")
    assert table(noisy, ["member_id", "event_date"], "bad")[1, d("2024-02-01")] == 1


def test_daily_feature_blocks(spark):
    log = ev.event_log(feeds(spark))
    anchors = spark.createDataFrame([(1, d("2024-01-20")), (3, d("2024-01-20"))], "member_id long, event_date date")
    real = table(dy.realtime_lookback(anchors, log), "member_id", "cnt_ed_adt_90d", "cnt_ip_adt_180d")
    assert real == {1: (1, 0), 3: (0, 1)}
    late = spark.createDataFrame([(1, d("2024-06-20"))], "member_id long, event_date date")
    claim = dy.claim_lookback(late, lines(spark), 4).first()
    assert claim["paid_sum_180d"] == 25.0 and claim["cnt_ed_visits_180d"] == 1 and claim["cnt_ed_visits_90d"] == 0
    extra = days_frame = spark.createDataFrame([(1, d("2024-01-07"), d("2000-01-01"), "female", "engaged_in_program", "ABD")],
                                               "member_id long, event_date date, dob date, gender string, engagement_group string, normalized_coverage string")
    got = dy.modelling_columns(days_frame).first()
    assert (got["day_of_week"], got["is_female"], got["is_engaged_in_program"], got["is_category_abd"]) == (0, 1, 1, 1)
    assert extra is days_frame


def test_labelled_events_carry_member_and_day(spark):
    log = ev.event_log(feeds(spark))
    members = spark.createDataFrame([(1, "m", d("2000-01-01"), "F", "engaged_in_program", "ABD", 3, True, True)],
                                    "member_id long, market string, dob date, gender string, engagement_group string, normalized_coverage string, "
                                    "months_since_batched int, has_ever_been_engaged boolean, is_batched boolean")
    out = ev.labelled_events(log, members, ev.day_labels(ev.combined_signal(log), (30,)))
    assert out.where("member_id <> 1").count() == 0 and out.where("market = 'm' AND y_any_30d IS NOT NULL").count() == log.where("member_id = 1").count()
