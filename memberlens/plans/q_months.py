"""Member-month queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.operators import clinical as cl
from memberlens.operators import eventlog as ev
from memberlens.operators import months as mo
from memberlens.plans import roles as r
from memberlens.plans.registry import Tables, query, role
from memberlens.sources.tables import bucketed, co_partitioned, kept_in_place, stored, wide_rows

CUTOFF = r.LAST_MONTH
MARKETS = ["nation_1", "nation_2", "nation_3"]
PREFIXES = {"is_auto": "AUT", "is_building": "BUIL", "is_furniture": "FUR"}


# ---- eligibility and demographics ----------------------------------------------------------------------

def spans(t):
    return mo.eligibility_spans(r.eligibility(t), CUTOFF)


SPANS = r.ELIGIBILITY + f""",
enrolled AS (
  SELECT member_id, month, month_end, CASE WHEN is_continuously_enrolled THEN 1 ELSE 0 END AS is_enrolled
  FROM eligibility WHERE month <= DATE '{CUTOFF}'),
spans AS (
  SELECT e.member_id, e.month, month_end, is_enrolled,
         CASE WHEN is_enrolled = 1 AND LAG(is_enrolled) OVER (PARTITION BY e.member_id ORDER BY e.month) = 0 THEN 1 ELSE 0 END AS is_reinstated,
         CASE WHEN is_enrolled = 0 THEN 1 WHEN e.month = l.last_month AND l.last_month < DATE '{CUTOFF}' THEN 1 ELSE 0 END AS is_disenrolled
  FROM enrolled e JOIN (SELECT member_id, MAX(month) AS last_month FROM enrolled GROUP BY 1) l ON l.member_id = e.member_id)"""


@query("k15_eligibility_spans", r.sql(SPANS, body="SELECT * FROM spans"))
def k15(t):
    return spans(t)


BANDS = ", ".join(f"CASE WHEN a >= {lo} AND a < {lo + 5} THEN 1 ELSE 0 END AS is_age_{lo}_{lo + 4}" for lo in range(15, 100, 5))
CALENDAR = ", ".join(f"CASE WHEN MONTH(s.month) = {i} THEN 1 ELSE 0 END AS is_{n}" for i, n in enumerate(codes.MONTH_NAMES, 1))
DEMOGRAPHICS = f"""
demo AS (
  SELECT member_id, CASE WHEN LEFT(UPPER(gender), 1) = 'M' THEN 1 ELSE 0 END AS is_male,
         CASE WHEN LEFT(UPPER(gender), 1) = 'F' THEN 1 ELSE 0 END AS is_female,
         CASE WHEN gender IS NULL OR LEFT(UPPER(gender), 1) NOT IN ('M', 'F') THEN 1 ELSE 0 END AS is_gender_unknown,
         CAST(FLOOR(a / 5) * 5 AS INTEGER) AS age_bucket, {BANDS}, CASE WHEN a >= 100 THEN 1 ELSE 0 END AS is_age_100_plus
  FROM (SELECT member_id, gender, 2023 - YEAR(dob) AS a FROM members))"""


@query("k16_unified_months", r.sql(SPANS, r.MEMBERS, DEMOGRAPHICS, body=f"""
SELECT s.*, YEAR(s.month)::INTEGER AS year, {CALENDAR}, d.* EXCLUDE (member_id) FROM spans s LEFT JOIN demo d ON d.member_id = s.member_id"""))
def k16(t):
    return mo.unified_months(spans(t), r.members(t))


@query("b7_calendar_flags", r.sql(r.ELIGIBILITY, body=f"SELECT s.member_id, s.month, YEAR(s.month)::INTEGER AS year, {CALENDAR} FROM eligibility s"))
def b7(t):
    return r.spine(t).select("member_id", "month", *mo.calendar_flags("month"))


# ---- engagement ----------------------------------------------------------------------------------------

ENGAGEMENT = """
engagement AS (
  SELECT s.member_id, s.month, CASE WHEN first_selected_date IS NOT NULL THEN 1 ELSE 0 END AS is_ever_selected,
         CASE WHEN DATE_TRUNC('month', first_selected_date) = s.month THEN 1 ELSE 0 END AS is_selected_month,
         CASE WHEN first_engaged_date IS NOT NULL THEN 1 ELSE 0 END AS is_ever_engaged,
         CASE WHEN DATE_TRUNC('month', first_engaged_date) = s.month THEN 1 ELSE 0 END AS is_engaged_month
  FROM spine s JOIN members m ON m.member_id = s.member_id)"""


@query("k17_engagement_months", r.sql(r.SPINE, r.MEMBERS, ENGAGEMENT, body="SELECT * FROM engagement"))
def k17(t):
    return mo.engagement_months(r.spine(t), r.members(t))


CONTACT = r.CONTACTS + """,
contact AS (
  SELECT member_id, month, ok AS successful_contact_attempts, bad AS unsuccessful_contact_attempts, ok + bad AS total_contact_attempts,
         CASE WHEN ok + bad >= 1 THEN 1 ELSE 0 END AS is_tried_contact_in_month,
         CASE WHEN ok >= 1 THEN 1 ELSE 0 END AS is_successful_contact_in_month,
         CASE WHEN ok + bad > 0 THEN ok::DOUBLE / (ok + bad) ELSE 0.0 END AS success_rate_this_month,
         CASE WHEN ok + bad >= 3 THEN 1 ELSE 0 END AS is_intense_attempt_in_month,
         CASE WHEN ok >= 2 THEN 1 ELSE 0 END AS is_intense_support_in_month
  FROM (SELECT s.member_id, s.month, COUNT(*) FILTER (c.status = 'successful') AS ok, COUNT(*) FILTER (c.status = 'unsuccessful') AS bad
        FROM spine s LEFT JOIN contacts c ON c.member_id = s.member_id AND CAST(DATE_TRUNC('month', c.contact_date) AS DATE) = s.month
         AND c.contact_subject = 'individual'
        GROUP BY 1, 2))"""


def contact(t, place=lambda months: months):
    contacts = r.contacts(t)
    return mo.contact_metrics(r.spine(t), contacts, weight="n" if "n" in contacts.columns else None, tried_from=1, succeeded_from=1, intense_from=3, support_from=2, place=place)


@query("k18_contact_metrics", r.sql(r.SPINE, CONTACT, body="SELECT * FROM contact"))
def k18(t):
    return contact(t)


@query("k19_contact_trend", r.sql(r.CONTACTS, body="""
, own AS (SELECT *, CAST(DATE_TRUNC('month', contact_date) AS DATE) AS cm FROM contacts WHERE contact_subject = 'individual'),
rates AS (
  SELECT c_custkey AS member_id, COALESCE(MAX(CASE WHEN status = 'successful' THEN 1 ELSE 0 END), 0) AS has_ever_successful_contact,
         COALESCE(MAX(CASE WHEN status = 'successful' AND cm = DATE '2001-03-01' THEN 1 ELSE 0 END), 0) AS has_successful_contact_this_month,
         COUNT(*) FILTER (status = 'successful' AND cm = DATE '2001-03-01')::DOUBLE / NULLIF(COUNT(*) FILTER (cm = DATE '2001-03-01'), 0) AS contact_success_rate_this_month,
         COUNT(*) FILTER (status = 'successful' AND cm BETWEEN DATE '2001-01-01' AND DATE '2001-03-01')::DOUBLE
           / NULLIF(COUNT(*) FILTER (cm BETWEEN DATE '2001-01-01' AND DATE '2001-03-01'), 0) AS contact_success_rate_3month
  FROM customer LEFT JOIN own ON own.member_id = c_custkey GROUP BY 1)
SELECT *, CASE WHEN contact_success_rate_this_month > contact_success_rate_3month THEN 'up'
               WHEN contact_success_rate_this_month < contact_success_rate_3month THEN 'down'
               WHEN contact_success_rate_this_month = contact_success_rate_3month THEN 'same' END AS contact_success_trend
FROM rates"""))
def k19(t):
    return mo.contact_trend(t.customer.select(F.col("c_custkey").alias("member_id")), r.contacts(t), "2001-03-01")


PHONE = """
phone AS (
  SELECT s.member_id, s.month, COALESCE(f.nr, 0) AS is_potentially_not_responsive
  FROM spine s LEFT JOIN (
    SELECT member_id, CAST(DATE_TRUNC('month', d) AS DATE) AS month, MAX(CASE WHEN first_d IS NULL THEN 1 ELSE 0 END) AS nr
    FROM (SELECT a.member_id, a.contact_date AS d, MIN(b.contact_date) AS first_d
          FROM contacts a LEFT JOIN contacts b ON b.member_id = a.member_id AND b.duration > 1 AND b.contact_date BETWEEN a.contact_date AND a.contact_date + 30
          WHERE a.duration <= 1 GROUP BY 1, 2)
    GROUP BY 1, 2) f ON f.member_id = s.member_id AND f.month = s.month)"""


def phone(t, place=lambda months: months):
    return mo.responsiveness(r.spine(t), r.contacts(t), within_days=30, place=place)


@query("k20_responsiveness", r.sql(r.SPINE, r.CONTACTS, PHONE, body="SELECT * FROM phone"))
def k20(t):
    return phone(t)


SMS = """
sms AS (
  SELECT s.member_id, s.month, CASE WHEN MAX(n) IS NOT NULL THEN 1 ELSE 0 END AS texted_in_month,
         CASE WHEN MAX(n) >= 2 THEN 1 ELSE 0 END AS likes_to_converse_by_text_in_month
  FROM spine s LEFT JOIN (SELECT member_id, filled_date AS contact_date, COUNT(*) AS n FROM fills GROUP BY 1, 2) f
    ON f.member_id = s.member_id AND CAST(DATE_TRUNC('month', contact_date) AS DATE) = s.month
  GROUP BY 1, 2)"""


def sms(t, place=lambda months: months):
    fills = r.fills(t).withColumnRenamed("filled_date", "contact_date")
    return mo.message_flags(r.spine(t), fills, burst=2, weight="n" if "n" in fills.columns else None, place=place)


@query("k21_message_bursts", r.sql(r.SPINE, r.FILLS, SMS, body="SELECT * FROM sms"))
def k21(t):
    return sms(t)


FLAGS = """
flags AS (
  SELECT e.*, c.* EXCLUDE (member_id, month), p.is_potentially_not_responsive, x.texted_in_month, x.likes_to_converse_by_text_in_month
  FROM engagement e JOIN contact c USING (member_id, month) JOIN phone p USING (member_id, month) JOIN sms x USING (member_id, month))"""


def flags(t, place=lambda months: months):
    return mo.engagement_flags(r.spine(t), mo.engagement_months(r.spine(t), r.members(t)), contact(t, place), phone(t, place), sms(t, place))


def trends(t, place=lambda months: months):
    return mo.engagement_trends(flags(t, place)).select(
        "member_id", "month", "became_non_responsive", "became_responsive", "increase_in_missed_calls", "started_texting",
        "stopped_texting", "started_conversing", "stopped_conversing", "success_rate_increased", "success_rate_decreased")


def beside_spine(t, table):
    """A table of member-months as a stage: its facts are laid where the spine is made, and its blocks are joined there."""
    with co_partitioned(t.spark):
        return stored(table(t, lambda months: r.beside_spine(t, months)), "member-month-table")


ALL_FLAGS = (r.SPINE, r.MEMBERS, ENGAGEMENT, CONTACT, PHONE, r.FILLS, SMS, FLAGS)


@query("k23_engagement_flags", r.sql(*ALL_FLAGS, body="SELECT * FROM flags"))
def k23(t):
    return beside_spine(t, flags)


@query("k22_engagement_trends", r.sql(*ALL_FLAGS, body="""
SELECT member_id, month,
       CASE WHEN LAG(is_potentially_not_responsive) OVER w = 0 AND is_potentially_not_responsive = 1 THEN 1 ELSE 0 END AS became_non_responsive,
       CASE WHEN LAG(is_potentially_not_responsive) OVER w = 1 AND is_potentially_not_responsive = 0 THEN 1 ELSE 0 END AS became_responsive,
       is_potentially_not_responsive - LAG(is_potentially_not_responsive) OVER w AS increase_in_missed_calls,
       CASE WHEN LAG(texted_in_month) OVER w = 0 AND texted_in_month = 1 THEN 1 ELSE 0 END AS started_texting,
       CASE WHEN LAG(texted_in_month) OVER w = 1 AND texted_in_month = 0 THEN 1 ELSE 0 END AS stopped_texting,
       CASE WHEN LAG(likes_to_converse_by_text_in_month) OVER w = 0 AND likes_to_converse_by_text_in_month = 1 THEN 1 ELSE 0 END AS started_conversing,
       CASE WHEN LAG(likes_to_converse_by_text_in_month) OVER w = 1 AND likes_to_converse_by_text_in_month = 0 THEN 1 ELSE 0 END AS stopped_conversing,
       CASE WHEN success_rate_this_month - LAG(success_rate_this_month) OVER w >= 0.2 THEN 1 ELSE 0 END AS success_rate_increased,
       CASE WHEN success_rate_this_month - LAG(success_rate_this_month) OVER w <= -0.2 THEN 1 ELSE 0 END AS success_rate_decreased
FROM flags WINDOW w AS (PARTITION BY member_id ORDER BY month)"""))
def k22(t):
    return beside_spine(t, trends)


# ---- conditions and treatment --------------------------------------------------------------------------

GROUP_OF = "CASE " + " ".join(f"WHEN hcc_code IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in codes.CONDITION_GROUPS.items()) \
    + " WHEN hcc_code IS NOT NULL THEN 'other_complex' END"
CONDITION = r.MAPPED + f""",
dx AS (SELECT *, {GROUP_OF} AS condition FROM mapped),
firsts_dx AS (SELECT member_id, {", ".join(f"MIN(CASE WHEN condition = '{c}' THEN service_date END) AS f_{c}" for c in cl.CONDITIONS)} FROM dx GROUP BY 1)"""


def mapped(t):
    return ev.mapped_diagnoses(r.diagnoses(t), r.code_map(t))


@role
def firsts(t):
    return cl.first_diagnosis_dates(mapped(t))


@role
def member_months(t):
    """Spans of all members, as a stage that all blocks start from."""
    return stored(spans(t).drop("month_end"), "member-months")


def _condition_sql(known):
    return ", ".join(f"CASE WHEN {known.format(c=c)} THEN 1 ELSE 0 END AS has_{c}, "
                     f"CASE WHEN DATE_TRUNC('month', f_{c}) = s.month THEN 1 ELSE 0 END AS first_diagnosis_{c}" for c in cl.CONDITIONS)


@query("k24_condition_months", r.sql(r.SPINE, CONDITION, body=f"""
SELECT s.member_id, s.month, {_condition_sql("f_{c} IS NOT NULL")} FROM spine s LEFT JOIN firsts_dx f ON f.member_id = s.member_id"""))
def k24(t):
    return cl.condition_flags(r.spine(t), firsts(t))


@query("k24_condition_months_bounded", r.sql(r.SPINE, CONDITION, body=f"""
SELECT s.member_id, s.month, {_condition_sql("DATE_TRUNC('month', f_{c}) <= s.month")} FROM spine s LEFT JOIN firsts_dx f ON f.member_id = s.member_id"""))
def k24_bounded(t):
    return cl.condition_flags(r.spine(t), firsts(t), bounded=True)


REQUIRED = f"""
required AS (
  SELECT s.member_id, s.month, {", ".join(f"CASE WHEN f_{c} <= s.month THEN 1 ELSE 0 END AS {c}_treatment_required" for c in cl.CONDITIONS)}
  FROM spine s LEFT JOIN firsts_dx f ON f.member_id = s.member_id)"""


@query("k25_treatment_required", r.sql(r.SPINE, CONDITION, REQUIRED, body="SELECT * FROM required"))
def k25(t):
    return cl.required_flags(r.spine(t), firsts(t))


@query("c15_first_date_join", r.sql(r.SPINE, CONDITION, body="""
SELECT s.member_id, s.month, CASE WHEN f.f_diabetes IS NOT NULL THEN 1 ELSE 0 END AS ever_by_this_month
FROM spine s LEFT JOIN firsts_dx f ON f.member_id = s.member_id AND f.f_diabetes <= s.month"""))
def c15(t):
    return cl.required_flags(r.spine(t), firsts(t)).select("member_id", "month", F.col("diabetes_treatment_required").alias("ever_by_this_month"))


TREATED = """
visits AS (SELECT DISTINCT member_id, claim_id, service_date FROM claims WHERE place_of_service IN ('11', '22', '49', '50')),
treated AS (
  SELECT DISTINCT v.member_id, v.service_date, CAST(DATE_TRUNC('month', v.service_date) AS DATE) AS tm, condition, provider_id
  FROM visits v JOIN dx ON dx.member_id = v.member_id AND dx.claim_id = v.claim_id AND dx.dx_line_number IN (1, 2) AND condition IS NOT NULL)"""


@role
def treatments(t):
    return cl.office_treatments(r.claims(t), mapped(t))


@query("k26_treatment_months", r.sql(r.SPINE, CONDITION, TREATED, body="SELECT s.member_id, s.month, " + ", ".join(
    f"MAX(CASE WHEN condition = '{c}' AND service_date < s.month THEN 1 ELSE 0 END) AS {c}_ever_treated, "
    f"MAX(CASE WHEN condition = '{c}' AND tm BETWEEN s.month - INTERVAL 2 MONTH AND s.month THEN 1 ELSE 0 END) AS {c}_treated_last_3_months, "
    f"MAX(CASE WHEN condition = '{c}' AND tm = s.month THEN 1 ELSE 0 END) AS {c}_treated_this_month" for c in cl.CONDITIONS)
    + " FROM spine s LEFT JOIN treated t ON t.member_id = s.member_id GROUP BY 1, 2"))
def k26(t):
    return cl.treatment_months(r.spine(t), treatments(t))


def _coordination(picked):
    return r.sql(r.SPINE, CONDITION, REQUIRED, TREATED, body=f"""
, counts AS (
  SELECT s.member_id, s.month, {", ".join(f"COUNT(DISTINCT CASE WHEN condition = '{c}' THEN provider_id END) AS n_{c}" for c in cl.CONDITIONS)}
  FROM spine s LEFT JOIN treated t ON t.member_id = s.member_id AND tm BETWEEN s.month - INTERVAL 2 MONTH AND s.month GROUP BY 1, 2),
sets AS (
  SELECT s.member_id, s.month, {", ".join(f"ARRAY_AGG(DISTINCT provider_id) FILTER (condition = '{c}' AND tm = s.month) AS now_{c}, ARRAY_AGG(DISTINCT provider_id) FILTER (condition = '{c}' AND tm < s.month) AS prev_{c}" for c in cl.CONDITIONS)}
  FROM spine s LEFT JOIN treated t ON t.member_id = s.member_id AND tm BETWEEN s.month - INTERVAL 2 MONTH AND s.month GROUP BY 1, 2)
SELECT {picked} FROM required r JOIN counts USING (member_id, month) JOIN sets USING (member_id, month)""")


def coordination(t):
    return cl.care_coordination(r.spine(t), treatments(t), cl.required_flags(r.spine(t), firsts(t)))


@query("k27_single_provider", _coordination("r.*, " + ", ".join(
    f"CASE WHEN {c}_treatment_required = 1 THEN CASE WHEN n_{c} = 1 THEN 1 ELSE 0 END END AS {c}_coordinated_care_last_3_months" for c in cl.CONDITIONS)))
def k27(t):
    out = coordination(t)
    return out.select(*[c for c in out.columns if not c.endswith("_new_provider_this_month")])


@query("k28_new_provider", _coordination("member_id, month, " + ", ".join(
    f"CASE WHEN {c}_treatment_required = 1 THEN CASE WHEN LEN(LIST_FILTER(COALESCE(now_{c}, []), lambda p: NOT LIST_CONTAINS(COALESCE(prev_{c}, []), p))) > 0 THEN 1 ELSE 0 END END AS {c}_new_provider_this_month"
    for c in cl.CONDITIONS)))
def k28(t):
    out = coordination(t)
    return out.select("member_id", "month", *[c for c in out.columns if c.endswith("_new_provider_this_month")])


# ---- pharmacy ------------------------------------------------------------------------------------------

DRUGS = {"insulin": "insulin", "oral_antidiabetic": "oral_antidiab", "beta_blocker": "beta_blocker", "opiate": "opioid", "antipsych": "antipsychotic"}


def _pharmacy_sql(mode):
    month_of = "CAST(DATE_TRUNC('month', filled_date) AS DATE)"
    if mode == "month":
        window = f"{month_of} BETWEEN s.month - INTERVAL 2 MONTH AND s.month"
        ever, first_only = "CAST(DATE_TRUNC('month', first_fill) AS DATE) <= s.month", ""
    else:
        window, ever, first_only = "filled_date BETWEEN s.month - INTERVAL 2 MONTH AND s.month", "first_fill <= s.month", " AND DAY(filled_date) = 1"
    parts, cols = [], []
    for n, c in DRUGS.items():
        parts.append(f"""
p_{n} AS (SELECT DISTINCT member_id, ndc, filled_date, days_supply FROM fills WHERE is_{c}),
e_{n} AS (SELECT member_id, MIN(filled_date) AS first_fill FROM p_{n} GROUP BY 1),
w_{n} AS (SELECT s.member_id, s.month, COUNT(DISTINCT ndc) AS n, COALESCE(SUM(days_supply), 0) / 90.0::DOUBLE AS mpr
  FROM spine s LEFT JOIN p_{n} p ON p.member_id = s.member_id AND {window} GROUP BY 1, 2),
r_{n} AS (SELECT DISTINCT member_id, {month_of} AS m FROM p_{n} WHERE TRUE{first_only}),
d_{n} AS (SELECT DISTINCT member_id, {month_of} AS m FROM (SELECT member_id, ndc, MIN(filled_date) AS filled_date FROM p_{n} GROUP BY 1, 2) WHERE TRUE{first_only})""")
        has = f"(e_{n}.first_fill IS NOT NULL AND {ever.replace('first_fill', f'e_{n}.first_fill')})"
        cols.append(f"""CASE WHEN {has} THEN 1 ELSE 0 END AS {n}_ever_prescribed, w_{n}.n AS num_{n}_drugs_last_3_months,
CASE WHEN {has} THEN w_{n}.mpr END AS {n}_mpr_last_3_months,
CASE WHEN {has} THEN CASE WHEN w_{n}.mpr >= 0.8 THEN 1 ELSE 0 END END AS {n}_med_adherent,
CASE WHEN q_{n}.m IS NOT NULL AND r_{n}.m IS NULL THEN 1 ELSE 0 END AS {n}_missed_refill_this_month,
CASE WHEN d_{n}.m IS NOT NULL THEN 1 ELSE 0 END AS {n}_new_drug_this_month""")
    joins = "".join(f"""
LEFT JOIN e_{n} ON e_{n}.member_id = s.member_id
JOIN w_{n} ON w_{n}.member_id = s.member_id AND w_{n}.month = s.month
LEFT JOIN r_{n} ON r_{n}.member_id = s.member_id AND r_{n}.m = s.month
LEFT JOIN r_{n} q_{n} ON q_{n}.member_id = s.member_id AND q_{n}.m = CAST(s.month - INTERVAL 1 MONTH AS DATE)
LEFT JOIN d_{n} ON d_{n}.member_id = s.member_id AND d_{n}.m = s.month""" for n in DRUGS)
    return r.sql(r.SPINE, r.FILLS, *parts, body="SELECT s.member_id, s.month, " + ", ".join(cols) + " FROM spine s" + joins)


def pharmacy(t, mode="month", place=lambda months: months):
    return cl.pharmacy_months(r.spine(t), r.fills(t), {n: F.col(f"is_{c}") for n, c in DRUGS.items()}, mode, place=place)


@query("k29_pharmacy_months", _pharmacy_sql("month"))
def k29(t):
    return pharmacy(t, place=lambda months: r.beside_spine(t, months))


@query("k29_pharmacy_months_by_date", _pharmacy_sql("date"))
def k29_date(t):
    return pharmacy(t, "date", lambda months: r.beside_spine(t, months))


# ---- windows over months -------------------------------------------------------------------------------

def _any(table, pred, lo, hi, name):
    """0/1: some row of ``table`` (member_id, d) with ``pred`` in months m+lo to m+hi."""
    return (f"CASE WHEN COUNT(*) FILTER ({pred} AND tm BETWEEN s.month + INTERVAL ({lo}) MONTH AND s.month + INTERVAL ({hi}) MONTH) > 0 "
            f"THEN 1 ELSE 0 END AS {name}")


@role
def facility_lines(t):
    """Claim lines whose supplier number stands for the place: lab, nursing facility or office."""
    return r.claims(t).withColumn("place_of_service", F.expr(
        "CASE WHEN provider_id < 10 THEN '81' WHEN provider_id < 15 THEN '31' WHEN provider_id < 20 THEN '32' ELSE '11' END"))


FACILITY = r.CLAIMS + """,
lines AS (
  SELECT member_id, CAST(DATE_TRUNC('month', service_date) AS DATE) AS tm,
         CASE WHEN provider_id < 10 THEN '81' WHEN provider_id < 15 THEN '31' WHEN provider_id < 20 THEN '32' ELSE '11' END AS place
  FROM claims)"""


@query("k30_any_in_window", r.sql(r.SPINE, FACILITY, body="SELECT s.member_id, s.month, " + ", ".join(
    [_any("lines", "place = '81'", -n, -1, f"lab_last_{n}_months") for n in (3, 6, 12)]
    + [_any("lines", "place IN ('31', '32')", 0, 0, "snf_this_month"), _any("lines", "place IN ('31', '32')", -3, 0, "snf_last_3_months")])
    + " FROM spine s LEFT JOIN lines l ON l.member_id = s.member_id GROUP BY 1, 2"))
def k30(t):
    return cl.facility_months(r.spine(t), facility_lines(t))


@query("c10_month_range_join", r.sql(r.SPINE, r.CLAIMS, body="""
SELECT s.member_id, s.month, COUNT(c.claim_id) AS lines_last_3, CAST(COALESCE(SUM(c.paid_amount), 0) AS DOUBLE) AS paid_last_3,
       COUNT(DISTINCT c.service_date) AS days_last_3
FROM spine s LEFT JOIN claims c ON c.member_id = s.member_id AND c.service_date >= s.month - INTERVAL 3 MONTH AND c.service_date < s.month
GROUP BY 1, 2"""))
def c10(t):
    return mo.lb.month_windows(r.spine(t), [(r.claims(t), "service_date", [
        mo.lb.MonthMeasure({"lines_last_3": (-3, -1)}, F.col("claim_id").isNotNull(), "count"),
        mo.lb.MonthMeasure({"paid_last_3": (-3, -1)}, F.col("paid_amount"), "total"),
        mo.lb.MonthMeasure({"days_last_3": (-3, -1)}, F.col("claim_id").isNotNull(), "days"),
    ])]).withColumn("paid_last_3", F.col("paid_last_3").cast("double"))


def checks(t):
    """Orders as health checks with escalations: status and priority give the answers, a month later the resolution."""
    created = F.col("day")
    return r.order_facts(t).select(
        "member_id", created.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("is_health_declining"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no").alias("has_medication_concerns"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "yes").otherwise("no").alias("has_health_concerns"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("has_escalation"), created.alias("escalation_created_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("is_escalation_resolved"),
        F.add_months(created, 1).alias("escalation_resolved_at"),
    )


def admissions(t):
    return r.claims(t).select(
        "member_id", F.col("service_date").alias("event_date"), (F.col("place_of_service") == "23").alias("is_ed_event"),
        (F.col("place_of_service") == "21").alias("is_ip_event"))


REALTIME = r.CLAIMS + """,
adt AS (SELECT member_id, CAST(DATE_TRUNC('month', service_date) AS DATE) AS tm, place_of_service = '23' AS ed, place_of_service = '21' AS ip FROM claims),
chk AS (
  SELECT o_custkey AS member_id, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS tm,
         CAST(DATE_TRUNC('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS resolved_tm, o_orderstatus AS st, o_orderpriority AS pr
  FROM orders),
a AS (SELECT s.member_id, s.month, %s FROM spine s LEFT JOIN adt l ON l.member_id = s.member_id GROUP BY 1, 2),
c AS (SELECT s.member_id, s.month, %s FROM spine s LEFT JOIN chk l ON l.member_id = s.member_id GROUP BY 1, 2)""" % (
    ", ".join(_any("adt", k, lo, 0, f"had_{k}_event_{w}") for k in ("ed", "ip") for lo, w in ((0, "this_month"), (-3, "last_3_months"))),
    ", ".join([
        _any("chk", "pr = '3-MEDIUM'", 0, 0, "needed_triage_escalation_this_month"),
        _any("chk", "pr = '3-MEDIUM' AND st <> 'O'", 0, 0, "triage_escalation_unresolved_this_month"),
        "CASE WHEN COUNT(*) FILTER (st = 'O' AND resolved_tm = s.month) > 0 THEN 1 ELSE 0 END AS triage_escalation_resolved_this_month",
        _any("chk", "st = 'F'", 0, 0, "deteriorating_condition_this_month"),
        _any("chk", "pr = '1-URGENT'", 0, 0, "had_medication_concern_this_month"),
        _any("chk", "pr = '2-HIGH'", 0, 0, "had_medical_needs_this_month")]))


@query("k31_realtime_and_escalation", r.sql(r.SPINE, REALTIME, body="SELECT * FROM a JOIN c USING (member_id, month)"))
def k31(t):
    return cl.realtime_months(r.spine(t), admissions(t), checks(t))


NOTE_MONTHS = r.NOTES_OVER_TIME + """,
note_months AS (SELECT s.member_id, s.month, %s
  FROM spine s LEFT JOIN notes_over_time n ON n.member_id = s.member_id AND CAST(DATE_TRUNC('month', note_date) AS DATE) = s.month GROUP BY 1, 2)""" % ", ".join(
    f"COALESCE(MAX(CASE WHEN category = '{c.upper()}' THEN 1 ELSE 0 END), 0) AS {c.lower()}_present_this_month, "
    f"CASE WHEN MAX(CASE WHEN category = '{c.upper()}' THEN score END) >= 3 THEN 1 "
    f"WHEN MAX(CASE WHEN category = '{c.upper()}' THEN 1 ELSE 0 END) = 1 THEN 0 END AS {c.lower()}_score_high_this_month" for c in codes.NOTE_CATEGORIES)


@query("k32_note_months", r.sql(r.SPINE, NOTE_MONTHS, body="SELECT * FROM note_months"))
def k32(t):
    return mo.notes_months(r.spine(t), r.note_scores_over_time(t))


# The published literals, stated here again so that a wrong constant in the library shows.
ED_LISTED = ["0450", "0451", "0452", "0456", "0459", "0981"]
IP_LISTED = [
    "0100", "0110", "0120", "0130", "0140", "0150", "0160", "0170", "0180", "0190", "0200", "0121", "0122", "0123", "0131",
    "0132", "0133", "0141", "0142", "0143", "0151", "0152", "0153",
]
EVENT_DAYS = """
event_days AS (
  SELECT s.member_id, s.month, %s
  FROM (SELECT member_id, month FROM spans WHERE is_enrolled = 1) s
  LEFT JOIN (SELECT member_id, service_date AS d, CAST(DATE_TRUNC('month', service_date) AS DATE) AS tm, revenue_code AS rc FROM claims) c
    ON c.member_id = s.member_id GROUP BY 1, 2)""" % ", ".join(
    f"COUNT(DISTINCT CASE WHEN rc IN ({', '.join(repr(x) for x in listed)}) AND tm BETWEEN s.month + INTERVAL ({lo}) MONTH AND s.month + INTERVAL ({hi}) MONTH THEN d END) AS {k}_events_{w}"
    for k, listed in (("ed", ED_LISTED), ("ip", IP_LISTED))
    for lo, hi, w in ((0, 0, "in_month"), (-2, 0, "last_3_months"), (-5, -3, "last_3_6_months")))


def event_days(t):
    enrolled = spans(t).where("is_enrolled = 1").select("member_id", "month")
    return cl.event_day_months(enrolled, r.claims(t))


@query("k33_event_days", r.sql(SPANS, r.CLAIMS, EVENT_DAYS, body="SELECT * FROM event_days"))
def k33(t):
    return event_days(t)


@query("d18_correlated_counts", r.sql(SPANS, r.CLAIMS, body="""
SELECT s.member_id, s.month,
       (SELECT COUNT(DISTINCT service_date) FROM claims c WHERE c.member_id = s.member_id AND c.revenue_code = '0450'
         AND c.service_date >= s.month AND c.service_date < s.month + INTERVAL 1 MONTH) AS ed_days_in_month
FROM spans s WHERE is_enrolled = 1"""))
def d18(t):
    return event_days(t).select("member_id", "month", F.col("ed_events_in_month").alias("ed_days_in_month"))


LABELS = """
labels_m AS (
  SELECT a.member_id, a.month, %s,
         CASE WHEN MAX(f.is_enrolled) = 1 THEN 1 ELSE 0 END AS is_active_next_90d
  FROM event_days a LEFT JOIN event_days b ON b.member_id = a.member_id AND b.month BETWEEN a.month + INTERVAL 1 MONTH AND a.month + INTERVAL 3 MONTH
  LEFT JOIN spans f ON f.member_id = a.member_id AND f.month = CAST(a.month + INTERVAL 3 MONTH AS DATE)
  GROUP BY 1, 2)""" % ", ".join(
    f"MAX(CASE WHEN b.month <= a.month + INTERVAL {n} MONTH AND b.{k}_events_in_month > 0 THEN 1 ELSE 0 END) AS {k}_event_next_{30 * n}d"
    for k in ("ed", "ip") for n in (1, 2, 3))


def labels(t):
    return mo.month_labels(event_days(t), spans(t))


@query("k34_month_labels", r.sql(SPANS, r.CLAIMS, EVENT_DAYS, LABELS, body="SELECT * FROM labels_m"))
def k34(t):
    return labels(t)


@query("c12_forward_month_join", r.sql(r.ELIGIBILITY, body="""
SELECT a.member_id, a.month, MAX(CASE WHEN b.is_continuously_enrolled THEN 1 ELSE 0 END) AS enrolled_next_3
FROM eligibility a LEFT JOIN eligibility b ON b.member_id = a.member_id AND b.month BETWEEN a.month + INTERVAL 1 MONTH AND a.month + INTERVAL 3 MONTH
GROUP BY 1, 2"""))
def c12(t):
    months = r.eligibility(t)
    return mo.lb.month_windows(months.select("member_id", "month"), [(months, "month", [
        mo.lb.MonthMeasure({"enrolled_next_3": (1, 3)}, F.col("is_continuously_enrolled"))])])


# ---- assembly and cohorts ------------------------------------------------------------------------------

def consolidated(t):
    """The wide member-month table of the main blocks."""
    months = member_months(t)
    spine, members = months.select("member_id", "month"), r.members(t)
    days = cl.event_day_months(months.where("is_enrolled = 1").select("member_id", "month"), r.claims(t))
    return mo.star_join(
        months,
        [mo.engagement_months(spine, members), days, mo.month_labels(days, months), mo.notes_months(spine, r.note_scores_over_time(t))],
        [mo.product_and_market_flags(members, MARKETS, PREFIXES), mo.demographics(members, "2023-01-01")],
    )


PRODUCTS = """
products AS (
  SELECT member_id, CASE WHEN LEFT(UPPER(TRIM(coverage)), 3) = 'AUT' THEN 1 ELSE 0 END AS is_auto,
         CASE WHEN LEFT(UPPER(TRIM(coverage)), 4) = 'BUIL' THEN 1 ELSE 0 END AS is_building,
         CASE WHEN LEFT(UPPER(TRIM(coverage)), 3) = 'FUR' THEN 1 ELSE 0 END AS is_furniture,
         CASE WHEN LEFT(UPPER(TRIM(coverage)), 3) NOT IN ('AUT', 'FUR') AND LEFT(UPPER(TRIM(coverage)), 4) <> 'BUIL' THEN 1 ELSE 0 END AS is_other,
         %s, CASE WHEN market IS NULL OR market NOT IN ('nation_1', 'nation_2', 'nation_3') THEN 1 ELSE 0 END AS is_market_other
  FROM members)""" % ", ".join(f"CASE WHEN market = '{m}' THEN 1 ELSE 0 END AS is_market_{m}" for m in MARKETS)
WIDE = (SPANS, r.SPINE, r.MEMBERS, ENGAGEMENT, r.CLAIMS, EVENT_DAYS, LABELS, NOTE_MONTHS, PRODUCTS, DEMOGRAPHICS)
WIDE_SQL = """
wide AS (
  SELECT s.member_id, s.month, p.* EXCLUDE (member_id), d.* EXCLUDE (member_id), e.is_enrolled, e.is_reinstated, e.is_disenrolled,
         g.* EXCLUDE (member_id, month), v.* EXCLUDE (member_id, month), l.* EXCLUDE (member_id, month), n.* EXCLUDE (member_id, month)
  FROM spine s LEFT JOIN products p ON p.member_id = s.member_id LEFT JOIN demo d ON d.member_id = s.member_id
  LEFT JOIN spans e ON e.member_id = s.member_id AND e.month = s.month
  LEFT JOIN engagement g ON g.member_id = s.member_id AND g.month = s.month
  LEFT JOIN event_days v ON v.member_id = s.member_id AND v.month = s.month
  LEFT JOIN labels_m l ON l.member_id = s.member_id AND l.month = s.month
  LEFT JOIN note_months n ON n.member_id = s.member_id AND n.month = s.month)"""


def wide_sql(body):
    shared = [SPANS, ", spine AS (SELECT member_id, month FROM eligibility)", r.MEMBERS, ENGAGEMENT, r.CLAIMS, EVENT_DAYS, LABELS, NOTE_MONTHS, PRODUCTS, DEMOGRAPHICS, WIDE_SQL]
    return "WITH " + ",".join(p.strip().lstrip(",").strip() for p in shared) + "\n" + body


@query("k35_consolidated_months", wide_sql("SELECT * FROM wide"))
def k35(t):
    return published(t, consolidated, MAIN_FEEDS)


def all_blocks(t, keep=lambda block: block):
    """The wide table with every block: calendar, contacts and their trends, conditions, treatment, care coordination,
    pharmacy, facilities and real-time feeds beside the main ones. ``keep`` may make each block a stage."""
    care = coordination(t)
    names = ["is_ever_selected", "is_selected_month", "is_ever_engaged", "is_engaged_month"]  # are in the main blocks
    blocks = [
        b7(t), flags(t).drop(*names), trends(t), k24(t), k26(t), care, pharmacy(t), k30(t), k31(t),
    ]
    return mo.star_join(keep(consolidated(t)), [keep(b) for b in blocks])


def kept_blocks(t):
    """All blocks, each written where it lies first: a task then sorts for one block at a time and at last for the joins."""
    return all_blocks(t, lambda block: kept_in_place(block, "wide-block", "member_id", ["month"]))


MAIN_FEEDS = ("members", "eligibility", "claims")
ALL_FEEDS = (*MAIN_FEEDS, "facility_lines", "firsts", "treatments", "fills")


def co_located(t, names=ALL_FEEDS):
    """The named feeds of the wide table as stages that lie together by member.

    Order lines are read once and orders twice. Every feed is reduced before it is shuffled: to person-days with counts, or to
    the distinct rows that its measures can tell apart; a person who holds a third of all rows is a row per day.
    """
    raw, out = r.claim_stage(t) if set(names) - set(MAIN_FEEDS) else t, Tables(t.spark, t.folder)
    lines = r.claims(raw)

    def counted(df):
        return df.groupBy(df.columns).agg(F.count("*").alias("n"))

    out.stages["order_facts"] = bucketed(counted(r.order_facts(t).drop("contact_id")), "order-days", "member_id")

    feeds = {
        "members": lambda: r.members(out), "eligibility": lambda: r.eligibility(out), "firsts": lambda: firsts(raw), "treatments": lambda: treatments(raw),
        "claims": lambda: lines.select("member_id", "service_date", "place_of_service", "revenue_code").distinct(),
        "facility_lines": lambda: facility_lines(raw).select("member_id", "service_date", "place_of_service").distinct(),
        "fills": lambda: counted(r.fills(raw)),
    }
    out.stages |= {name: bucketed(feeds[name](), name, "member_id") for name in names}
    out.stages["member_months"] = bucketed(spans(out).drop("month_end"), "member-months", "member_id")
    return out


def published(t, table, names=ALL_FEEDS):
    """A wide table as a stage of its own, joined where its blocks lie."""
    with co_partitioned(t.spark), wide_rows(t.spark):
        return stored(table(co_located(t, names)), "wide-table")


def all_blocks_sql(body):
    """The same from the blocks' own SQL."""
    from memberlens.plans.registry import ORACLES

    blocks = {
        "k35_consolidated_months": "", "b7_calendar_flags": "", "k23_engagement_flags": "is_ever_selected, is_selected_month, is_ever_engaged, is_engaged_month",
        "k22_engagement_trends": "", "k24_condition_months": "", "k26_treatment_months": "", "k27_single_provider": "", "k28_new_provider": "",
        "k29_pharmacy_months": "", "k30_any_in_window": "", "k31_realtime_and_escalation": "",
    }
    picked = [f"(SELECT *{f' EXCLUDE ({out})' if out else ''} FROM ({ORACLES[name]})) b{i}" for i, (name, out) in enumerate(blocks.items())]
    return body % (picked[0] + "".join(f" LEFT JOIN {p} USING (member_id, month)" for p in picked[1:]))


@query("k35_all_blocks", all_blocks_sql("SELECT * FROM %s"))
def k35_all(t):
    return published(t, kept_blocks)


@query("c3_star_join", wide_sql("SELECT member_id, month, is_auto, age_bucket, is_enrolled, is_ever_engaged, ed_events_in_month, is_active_next_90d, health_present_this_month FROM wide"))
def c3(t):
    return published(t, consolidated, MAIN_FEEDS).select("member_id", "month", "is_auto", "age_bucket", "is_enrolled", "is_ever_engaged", "ed_events_in_month",
                                  "is_active_next_90d", "health_present_this_month")


def _engaged_base(t):
    return mo.engagement_months(r.spine(t), r.members(t))


COHORT = (r.SPINE, r.MEMBERS, ENGAGEMENT)


@query("k36_engaged_window", r.sql(*COHORT, body="""
SELECT e.* FROM engagement e JOIN (SELECT member_id, MIN(month) AS f FROM engagement WHERE is_engaged_month = 1 GROUP BY 1) x ON x.member_id = e.member_id
WHERE e.month >= x.f - INTERVAL 12 MONTH"""))
def k36(t):
    return mo.cohort_window(_engaged_base(t), F.col("is_engaged_month") == 1)


@query("k36_selected_not_engaged", r.sql(*COHORT, body="""
SELECT e.* FROM engagement e JOIN (SELECT member_id, MIN(month) AS f FROM engagement WHERE is_ever_engaged = 0 AND is_ever_selected = 1 GROUP BY 1) x ON x.member_id = e.member_id
WHERE e.month >= x.f - INTERVAL 12 MONTH"""))
def k36_selected(t):
    return mo.cohort_window(_engaged_base(t), (F.col("is_ever_engaged") == 0) & (F.col("is_ever_selected") == 1))


@query("k36_master", r.sql(*COHORT, body="""
, f AS (SELECT member_id, MIN(month) AS f FROM engagement WHERE is_engaged_month = 1 GROUP BY 1)
SELECT e.* FROM engagement e JOIN f ON f.member_id = e.member_id WHERE e.month <= f.f + INTERVAL 3 MONTH
UNION SELECT e.* FROM engagement e WHERE e.member_id NOT IN (SELECT member_id FROM f)"""))
def k36_master(t):
    return mo.master_cohort(_engaged_base(t), F.col("is_engaged_month") == 1)
