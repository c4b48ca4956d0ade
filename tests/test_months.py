from pyspark.sql import functions as F

from memberlens.operators import clinical as cl
from memberlens.operators import months as mo
from tests.helpers import d, rows, table

KEYS = ["member_id", "month"]


def spine(spark, *pairs):
    return spark.createDataFrame([(m, d(x)) for m, x in pairs], "member_id long, month date")


def test_eligibility_spans(spark):
    months = spark.createDataFrame([
        (1, d("2024-01-01"), True), (1, d("2024-02-01"), None), (1, d("2024-03-01"), True), (2, d("2024-11-01"), True), (2, d("2024-12-01"), True),
        (2, d("2025-01-01"), True)], "member_id long, month date, is_continuously_enrolled boolean").withColumn("month_end", F.last_day("month"))
    got = table(mo.eligibility_spans(months, "2024-12-01"), KEYS, "is_enrolled", "is_reinstated", "is_disenrolled")
    assert got == {(1, d("2024-01-01")): (1, 0, 0), (1, d("2024-02-01")): (0, 0, 1), (1, d("2024-03-01")): (1, 1, 1),
                   (2, d("2024-11-01")): (1, 0, 0), (2, d("2024-12-01")): (1, 0, 0)}


def test_contact_metrics_and_trend(spark):
    contacts = spark.createDataFrame([
        (1, d("2024-03-05"), "successful", "individual"), (1, d("2024-03-06"), "unsuccessful", "individual"), (1, d("2024-02-06"), "successful", "individual"),
        (1, d("2024-03-07"), "successful", "caregiver"), (2, d("2023-01-01"), "successful", "individual")],
        "member_id long, contact_date date, status string, contact_subject string")
    got = table(mo.contact_metrics(spine(spark, (1, "2024-03-01"), (1, "2024-02-01"), (2, "2024-03-01")), contacts), KEYS,
                "total_contact_attempts", "success_rate_this_month", "is_tried_contact_in_month", "is_successful_contact_in_month")
    assert got == {(1, d("2024-03-01")): (2, 0.5, 1, 0), (1, d("2024-02-01")): (1, 1.0, 0, 0), (2, d("2024-03-01")): (0, 0.0, 0, 0)}
    members = spark.createDataFrame([(1,), (2,), (3,)], "member_id long")
    trend = table(mo.contact_trend(members, contacts, "2024-03-01"), "member_id", "has_ever_successful_contact", "contact_success_trend")
    assert trend == {1: (1, "down"), 2: (1, None), 3: (0, None)}


def test_responsiveness_and_bursts(spark):
    calls = spark.createDataFrame([(1, d("2024-01-30"), 0), (1, d("2024-02-01"), 5), (1, d("2024-02-10"), 1), (1, d("2024-02-20"), 9)], "member_id long, contact_date date, duration int")
    sp = spine(spark, (1, "2024-01-01"), (1, "2024-02-01"), (1, "2024-03-01"))
    assert table(mo.responsiveness(sp, calls), "month", "is_potentially_not_responsive") == {d("2024-01-01"): 0, d("2024-02-01"): 1, d("2024-03-01"): 0}
    sms = spark.createDataFrame([(1, d("2024-01-05"))] * 5 + [(1, d("2024-02-05"))] * 4, "member_id long, contact_date date")
    got = table(mo.message_flags(sp, sms), "month", "texted_in_month", "likes_to_converse_by_text_in_month")
    assert got == {d("2024-01-01"): (1, 1), d("2024-02-01"): (1, 0), d("2024-03-01"): (0, 0)}


def test_notes_are_three_state(spark):
    scores = spark.createDataFrame([(1, d("2024-01-05"), "SELF", 2), (1, d("2024-02-05"), "SELF", 3)], "member_id long, note_date date, category string, score long")
    got = table(mo.notes_months(spine(spark, (1, "2024-01-01"), (1, "2024-02-01"), (1, "2024-03-01")), scores), "month", "self_present_this_month", "self_score_high_this_month")
    assert got == {d("2024-01-01"): (1, 0), d("2024-02-01"): (1, 1), d("2024-03-01"): (0, None)}


def dx(spark, *data):
    return spark.createDataFrame([(m, c, line, code, p, pl, d(day)) for m, c, line, code, p, pl, day in data],
                                 "member_id long, claim_id long, dx_line_number int, hcc_code int, provider_id long, place_of_service string, service_date date")


def test_conditions_bounded_and_unbounded(spark):
    data = dx(spark, (1, 1, 1, 36, 5, "11", "2024-02-10"), (1, 2, 1, 999, 5, "11", "2024-01-10"), (1, 3, 1, None, 5, "11", "2024-01-01"))
    sp = spine(spark, (1, "2024-01-01"), (1, "2024-02-01"), (1, "2024-03-01"), (2, "2024-01-01"))
    both = [table(cl.condition_months(sp, data, b), KEYS, "has_diabetes", "first_diagnosis_diabetes", "has_other_complex") for b in (False, True)]
    assert both[0][1, d("2024-01-01")] == (1, 0, 1) and both[1][1, d("2024-01-01")] == (0, 0, 1)
    assert both[1][1, d("2024-02-01")] == (1, 1, 1) and both[0][2, d("2024-01-01")] == (0, 0, 0)
    need = table(cl.treatment_required(sp, data), KEYS, "diabetes_treatment_required")
    assert (need[1, d("2024-02-01")], need[1, d("2024-03-01")]) == (0, 1)


def test_coordination_and_new_providers(spark):
    data = dx(spark, (1, 1, 1, 36, 5, "11", "2024-01-10"), (1, 2, 1, 36, 5, "11", "2024-02-10"), (1, 3, 2, 36, 6, "11", "2024-04-10"), (1, 4, 3, 36, 7, "11", "2024-04-10"),
              (1, 5, 1, 36, 8, "23", "2024-04-10"))
    lines = data.select("member_id", "claim_id", "service_date", "place_of_service")
    treated = cl.office_treatments(lines, data)
    assert rows(treated, "provider_id", "service_month") == [(5, d("2024-01-01")), (5, d("2024-02-01")), (6, d("2024-04-01"))]
    sp = spine(spark, *[(1, f"2024-0{m}-01") for m in range(1, 8)])
    got = table(cl.care_coordination(sp, treated, cl.treatment_required(sp, data)), "month", "diabetes_coordinated_care_last_3_months", "diabetes_new_provider_this_month")
    assert got == {d("2024-01-01"): (None, None), d("2024-02-01"): (1, 0), d("2024-03-01"): (1, 0), d("2024-04-01"): (0, 1), d("2024-05-01"): (1, 0),
                   d("2024-06-01"): (1, 0), d("2024-07-01"): (0, 0)}
    when = table(cl.treatment_months(sp, treated), "month", "diabetes_ever_treated", "diabetes_treated_last_3_months", "diabetes_treated_this_month")
    assert when[d("2024-01-01")] == (0, 1, 1) and when[d("2024-03-01")] == (1, 1, 0) and when[d("2024-07-01")] == (1, 0, 0)


def test_pharmacy_modes(spark):
    fills = spark.createDataFrame([(1, 7, d("2024-01-15"), 30, True), (1, 7, d("2024-01-15"), 30, True), (1, 7, d("2024-02-01"), 60, True), (1, 8, d("2024-03-10"), 10, True), (1, 9, d("2024-01-02"), 5, False)],
                                  "member_id long, ndc long, filled_date date, days_supply int, is_insulin boolean")
    sp = spine(spark, *[(1, f"2024-0{m}-01") for m in range(1, 7)])
    cols = ["insulin_ever_prescribed", "num_insulin_drugs_last_3_months", "insulin_mpr_last_3_months", "insulin_missed_refill_this_month", "insulin_new_drug_this_month"]
    by_month = table(cl.pharmacy_months(sp, fills, {"insulin": F.col("is_insulin")}), "month", *cols)
    assert by_month[d("2024-01-01")] == (1, 1, 30 / 90, 0, 1)
    assert by_month[d("2024-03-01")] == (1, 2, 100 / 90, 0, 1)
    assert by_month[d("2024-04-01")] == (1, 2, 70 / 90, 1, 0)
    assert by_month[d("2024-06-01")] == (1, 0, 0.0, 0, 0)
    by_date = table(cl.pharmacy_months(sp, fills, {"insulin": F.col("is_insulin")}, "date"), "month", *cols)
    assert by_date[d("2024-01-01")] == (0, 0, None, 0, 0)
    assert by_date[d("2024-02-01")] == (1, 1, 1.0, 0, 0)
    assert by_date[d("2024-03-01")] == (1, 1, 1.0, 1, 0)


def test_facility_event_days_and_labels(spark):
    lines = spark.createDataFrame([(1, d("2024-01-05"), "81", "0450"), (1, d("2024-01-05"), "31", "0456"), (1, d("2024-03-09"), "32", "0120")],
                                  "member_id long, service_date date, place_of_service string, revenue_code string")
    sp = spine(spark, *[(1, f"2024-0{m}-01") for m in range(1, 6)])
    got = table(cl.facility_months(sp, lines), "month", "lab_last_3_months", "snf_this_month", "snf_last_3_months")
    assert got[d("2024-01-01")] == (0, 1, 1) and got[d("2024-04-01")] == (1, 0, 1) and got[d("2024-05-01")] == (0, 0, 1)
    days = cl.event_day_months(sp, lines)
    have = table(days, "month", "ed_events_in_month", "ed_events_last_3_months", "ed_events_last_3_6_months", "ip_events_in_month")
    assert have[d("2024-01-01")] == (1, 1, 0, 0) and have[d("2024-03-01")] == (0, 1, 0, 1) and have[d("2024-04-01")] == (0, 0, 1, 0)
    enrolled = sp.withColumn("is_enrolled", F.when(F.col("month") == d("2024-05-01"), 0).otherwise(1))
    labels = table(mo.month_labels(days, enrolled), "month", "ip_event_next_30d", "ip_event_next_60d", "is_active_next_90d")
    assert labels[d("2024-01-01")] == (0, 1, 1) and labels[d("2024-02-01")] == (1, 1, 0) and labels[d("2024-03-01")] == (0, 0, 0)


def test_cohort_windows(spark):
    data = spark.createDataFrame([(1, d("2023-01-01"), 0), (1, d("2024-02-01"), 0), (1, d("2024-06-01"), 1), (1, d("2024-12-01"), 1), (2, d("2024-01-01"), 0), (2, d("2024-01-01"), 0)],
                                 "member_id long, month date, is_engaged int")
    engaged = F.col("is_engaged") == 1
    assert [r[1] for r in rows(mo.cohort_window(data, engaged), *KEYS)] == [d("2024-02-01"), d("2024-06-01"), d("2024-12-01")]
    assert rows(mo.master_cohort(data, engaged), *KEYS) == [(1, d("2023-01-01")), (1, d("2024-02-01")), (1, d("2024-06-01")), (2, d("2024-01-01"))]


def test_spans_become_dense_and_blocks_join(spark):
    spans = spark.createDataFrame([(1, d("2023-12-01"), d("2024-02-01"))], "member_id long, first_month date, last_month date")
    sp = mo.dense_months(spans)
    assert [r[1] for r in rows(sp)] == [d("2023-12-01"), d("2024-01-01"), d("2024-02-01")]
    members = spark.createDataFrame([(1, "M", d("1990-06-01"), "abd x", "tacoma", d("2024-01-15"), None)],
                                    "member_id long, gender string, dob date, coverage string, market string, first_selected_date date, first_engaged_date date")
    wide = mo.star_join(sp, [mo.engagement_months(sp, members)], [mo.product_and_market_flags(members), mo.demographics(members, "2023-01-01")])
    got = table(wide, "month", "is_selected_month", "is_ever_engaged", "is_abd", "is_market_tacoma", "is_market_other", "age_bucket", "is_age_30_34", "is_male")
    assert got[d("2024-01-01")] == (1, 0, 1, 1, 0, 30, 1, 1) and got[d("2023-12-01")][0] == 0
    trends = mo.engagement_trends(sp.withColumns({c: F.when(F.col("month") == d("2024-02-01"), 1).otherwise(0) for c in (
        "is_potentially_not_responsive", "texted_in_month", "likes_to_converse_by_text_in_month", "success_rate_this_month")}))
    feb = trends.where(F.col("month") == d("2024-02-01")).first()
    assert (feb["became_non_responsive"], feb["started_texting"], feb["stopped_texting"], feb["success_rate_increased"]) == (1, 1, 0, 1)
