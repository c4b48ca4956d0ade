"""Member-day queries: event log, lookbacks, labels and longitudinal features."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.functions.expr import flag
from memberlens.operators import daily as dy
from memberlens.operators import eventlog as ev
from memberlens.operators import lookback as lb
from memberlens.operators import windows as wn
from memberlens.plans import roles as r
from memberlens.plans import stages
from memberlens.plans.registry import query
from memberlens.sources.tables import co_partitioned, kept_in_place, shuffled_by_rows, stored, wide_rows

ASOF = "2002-01-01"


# ---- the event log -------------------------------------------------------------------------------------

def claim_log(t):
    """Claim and fill events of the whole tables, in the common shape."""
    s = r.claim_stage(t)
    lines, mapped = r.claims(s), ev.mapped_diagnoses(r.diagnoses(s), r.code_map(t))
    return ev.event_log([
        ev.diagnosis_events(lines, mapped), ev.line_events(lines), ev.fill_events(r.fills(s)),
    ])


def full_log(t):
    """One log of all feeds: claims, fills, admissions and scored notes."""
    s = r.claim_stage(t)
    lines, mapped = r.claims(s), ev.mapped_diagnoses(r.diagnoses(s), r.code_map(t))
    return ev.event_log([
        ev.diagnosis_events(lines, mapped), ev.line_events(lines), ev.fill_events(r.fills(s)),
        ev.admission_events(r.feed(t), "ADT", "adt"), ev.note_events(r.note_scores(t)),
    ])


def feed_log(t):
    """Admissions and scored notes from the events feed, in the common shape."""
    return ev.event_log([
        ev.admission_events(r.feed(t), "ADT", "adt"),
        ev.note_events(r.note_scores(t)),
    ])


IN_GROUP = {n: ", ".join(map(str, c)) for n, c in codes.CONDITION_GROUPS.items()}
ALL_CODES = ", ".join(str(c) for g in codes.CONDITION_GROUPS.values() for c in g)
CONDITION_SQL = ", ".join(
    [f"MAX(CASE WHEN hcc_code IN ({v}) THEN 1 ELSE 0 END) AS cnt_hcc_{k}" for k, v in IN_GROUP.items()]
    + [f"MAX(CASE WHEN hcc_code IS NOT NULL AND hcc_code NOT IN ({ALL_CODES}) THEN 1 ELSE 0 END) AS cnt_hcc_other_complex"]
)
THEME_SQL = ", ".join(
    f"MAX(CASE WHEN hcc_code IN ({', '.join(map(str, v))}) THEN 1 ELSE 0 END) AS has_{k}" for k, v in codes.THEMATIC_GROUPS.items()
)
ED = "(place_of_service = '23' OR LEFT(COALESCE(revenue_code, ''), 3) = '045')"
IP = "(place_of_service = '21' OR COALESCE(regexp_matches(revenue_code, '^(01[0-9]|02[0-1])'), FALSE))"
LINES = """
dx_claim AS (
  SELECT member_id, claim_id, MAX(hcc_code) AS hcc_category, %s, %s
  FROM mapped GROUP BY member_id, claim_id),
dx_lines AS (
  SELECT DISTINCT member_id, claim_id, claim_line_number, service_date, place_of_service, revenue_code, hcpcs_code, paid_amount
  FROM claims)""" % (CONDITION_SQL, THEME_SQL)
LOG = r.MAPPED + "," + LINES + """,
fills AS (
  SELECT member_id, service_date AS filled_date, part_id AS ndc, p_type AS drug_type, quantity AS days_supply
  FROM claims JOIN part ON p_partkey = part_id),
log AS (
  SELECT member_id, service_date AS event_date, 'CLAIM_DIAGNOSIS' AS event_type, CAST(NULL AS VARCHAR) AS code,
         %(ed)s AS is_ed_event, %(ip)s AS is_ip_event, paid_amount, hcc_category, has_hiv, has_diabetes, has_smi
  FROM dx_lines JOIN dx_claim USING (member_id, claim_id)
  UNION ALL
  SELECT member_id, service_date, 'CLAIM_REVENUE', revenue_code, %(ed)s, %(ip)s, paid_amount, NULL, NULL, NULL, NULL
  FROM claims WHERE revenue_code IS NOT NULL
  UNION ALL
  SELECT member_id, service_date, 'CLAIM_PROCEDURE', hcpcs_code, %(ed)s, %(ip)s, paid_amount, NULL, NULL, NULL, NULL
  FROM claims WHERE hcpcs_code IS NOT NULL
  UNION ALL
  SELECT member_id, filled_date, 'PHARMACY_FILL', CAST(ndc AS VARCHAR), FALSE, FALSE, NULL, NULL, NULL, NULL, NULL
  FROM fills WHERE days_supply > 0)""" % {"ed": ED, "ip": IP}


FULL_LOG = LOG + """,
feed AS (
  SELECT user_id AS member_id, CAST(ts AS DATE) AS admit_date, event_type, value,
         CASE event_type WHEN 'error' THEN 'ED' WHEN 'purchase' THEN 'Inpatient' ELSE event_type END AS setting,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
full_log AS (
  SELECT *, CAST(NULL AS BIGINT) AS score FROM log
  UNION ALL
  SELECT member_id, admit_date, 'ADT', setting, LOWER(setting) IN ('ed', 'emergency'), LOWER(setting) IN ('ip', 'inpatient', 'in-patient'),
         NULL, NULL, NULL, NULL, NULL, NULL FROM feed
  UNION ALL
  SELECT member_id, admit_date, 'CARE_NOTE',
         (['HEALTH', 'PROGRAM_TRUST', 'SELF', 'RISK_HARM', 'SOCIAL_STABILITY', 'MED_ADHERENCE', 'CARE_ENGAGEMENT'])[k % 7 + 1],
         FALSE, FALSE, NULL, NULL, NULL, NULL, NULL, CAST(k % 5 + 1 AS BIGINT) FROM feed)"""


@query("k1_event_log", r.sql(FULL_LOG, body="""
SELECT event_type, code, COUNT(*) AS n, MIN(event_date) AS first_date, MAX(event_date) AS last_date,
       COUNT(*) FILTER (is_ed_event) AS n_ed, COUNT(*) FILTER (is_ip_event) AS n_ip,
       CAST(SUM(paid_amount) AS DOUBLE) AS paid, SUM(score)::BIGINT AS score, COUNT(DISTINCT member_id) AS members
FROM full_log GROUP BY event_type, code"""))
def k1(t):
    return full_log(t).groupBy("event_type", "code").agg(
        F.count("*").alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.count_if("is_ed_event").alias("n_ed"), F.count_if("is_ip_event").alias("n_ip"),
        F.sum("paid_amount").cast("double").alias("paid"), F.sum("score").alias("score"), F.count_distinct("member_id").alias("members"),
    )


@query("k2_diagnosis_rollup", r.sql(r.MAPPED, LINES, body=f"""
SELECT member_id, claim_id, claim_line_number, service_date AS event_date, CAST(paid_amount AS DOUBLE) AS paid_amount,
       hcc_category, {", ".join("cnt_hcc_" + c for c in [*codes.CONDITION_GROUPS, "other_complex"])},
       {", ".join("has_" + c for c in codes.THEMATIC_GROUPS)}
FROM dx_lines JOIN dx_claim USING (member_id, claim_id)"""))
def k2(t):
    s = r.claim_stage(t)
    events = ev.diagnosis_events(r.claims(s), ev.mapped_diagnoses(r.diagnoses(s), r.code_map(t)))
    return events.select(
        "member_id", "claim_id", "claim_line_number", "event_date", F.col("paid_amount").cast("double").alias("paid_amount"),
        "hcc_category", *ev.CONDITION_COLUMNS, *ev.THEME_COLUMNS,
    )


FEED_SIGNAL = r.FEED + """,
daily AS (
  SELECT member_id, admit_date AS event_date,
         MAX(CASE WHEN setting = 'ED' THEN 1 ELSE 0 END) AS any_ed_on_date,
         MAX(CASE WHEN setting = 'Inpatient' THEN 1 ELSE 0 END) AS any_ip_on_date
  FROM feed GROUP BY 1, 2)"""


@query("k3_daily_signal", r.sql(FEED_SIGNAL, body="""
SELECT member_id, event_date, any_ed_on_date, any_ip_on_date, any_ip_on_date AS is_ip_adt, 0 AS is_ip_auth, 0 AS is_ip_hc,
       any_ed_on_date AS is_ed_adt, 0 AS is_ed_auth, 0 AS is_ed_hc
FROM daily"""))
def k3(t):
    return ev.daily_signal(feed_log(t))


FEED_DAILY = FEED_SIGNAL.replace("daily AS", "feed_daily AS")
CLAIM_SIGNAL = LOG + """,
daily AS (
  SELECT member_id, event_date, MAX(CASE WHEN is_ed_event THEN 1 ELSE 0 END) AS any_ed_on_date,
         MAX(CASE WHEN is_ip_event THEN 1 ELSE 0 END) AS any_ip_on_date
  FROM log GROUP BY 1, 2),
dxday AS (
  SELECT member_id, event_date, MAX(CASE WHEN has_hiv > 0 THEN 1 ELSE 0 END) AS has_hiv,
         MAX(CASE WHEN has_diabetes > 0 THEN 1 ELSE 0 END) AS has_diabetes,
         MAX(CASE WHEN has_smi > 0 THEN 1 ELSE 0 END) AS has_smi
  FROM log WHERE event_type = 'CLAIM_DIAGNOSIS' GROUP BY 1, 2),
signal AS (
  SELECT COALESCE(a.member_id, b.member_id) AS member_id, COALESCE(a.event_date, b.event_date) AS event_date,
         COALESCE(any_ed_on_date, 0) AS any_ed_on_date, COALESCE(any_ip_on_date, 0) AS any_ip_on_date,
         COALESCE(has_hiv, 0) AS has_hiv, COALESCE(has_diabetes, 0) AS has_diabetes, COALESCE(has_smi, 0) AS has_smi
  FROM daily a FULL OUTER JOIN dxday b ON a.member_id = b.member_id AND a.event_date = b.event_date)"""


def claim_signal(t):
    s = r.claim_stage(t)
    return ev.line_signal(r.claims(s), ev.mapped_diagnoses(r.diagnoses(s), r.code_map(t)), r.fills(s))


@query("k4_joined_signals", r.sql(CLAIM_SIGNAL, FEED_DAILY, body="""
SELECT COALESCE(a.member_id, b.member_id) AS member_id, COALESCE(a.event_date, b.event_date) AS event_date, COALESCE(a.any_ed_on_date, 0) AS any_ed_on_date,
       COALESCE(a.any_ip_on_date, 0) AS any_ip_on_date, COALESCE(b.has_diabetes, 0) AS has_diabetes, COALESCE(b.has_smi, 0) AS has_smi
FROM feed_daily a FULL OUTER JOIN dxday b ON a.member_id = b.member_id AND a.event_date = b.event_date"""))
def k4_joined(t):
    both = ev.joined_signals(ev.daily_signal(feed_log(t)), ev.diagnosis_signal(claim_log(t)))
    return both.select("member_id", "event_date", "any_ed_on_date", "any_ip_on_date", "has_diabetes", "has_smi")


@query("k4_combined_signal", r.sql(CLAIM_SIGNAL, body="SELECT * FROM signal"))
def k4(t):
    return claim_signal(t).select("member_id", "event_date", "any_ed_on_date", "any_ip_on_date", "has_hiv", "has_diabetes", "has_smi")


def _label_sql(horizons, frame):
    out = []
    for n in horizons:
        w = frame % n
        out += [f"MAX(any_ed_on_date) OVER ({w}) AS y_ed_{n}d", f"MAX(any_ip_on_date) OVER ({w}) AS y_ip_{n}d",
                f"GREATEST(COALESCE(MAX(any_ed_on_date) OVER ({w}), 0), COALESCE(MAX(any_ip_on_date) OVER ({w}), 0)) AS y_any_{n}d"]
    return ", ".join(out)


DAY_FRAME = "PARTITION BY member_id ORDER BY event_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL %d DAY FOLLOWING"
ROW_FRAME = "PARTITION BY member_id ORDER BY event_date ROWS BETWEEN 1 FOLLOWING AND %d FOLLOWING"
KEYS = "member_id, event_date, "


@query("k4_signal_of_log", r.sql(CLAIM_SIGNAL, body="SELECT * FROM signal"))
def k4_log(t):
    """The same days drawn from the finished log."""
    days = ev.combined_signal(claim_log(t))
    return days.select("member_id", "event_date", "any_ed_on_date", "any_ip_on_date", "has_hiv", "has_diabetes", "has_smi")


@query("k1_labelled_events", r.sql(CLAIM_SIGNAL, r.MEMBERS, body=f"""
, labels AS (SELECT {KEYS}{_label_sql((30,), DAY_FRAME)} FROM signal)
SELECT event_type, market, COUNT(*) AS n, SUM(y_ed_30d)::BIGINT AS y_ed, SUM(y_ip_30d)::BIGINT AS y_ip, SUM(y_any_30d)::BIGINT AS y_any
FROM log JOIN members USING (member_id) LEFT JOIN labels USING (member_id, event_date)
WHERE market IS NOT NULL GROUP BY event_type, market"""))
def k1_labelled(t):
    members = ev.cohort(r.members(t), None, F.lit(ASOF).cast("date"))
    log = stored(claim_log(t), "event-log")
    events = ev.labelled_events(log, members, ev.day_labels(ev.combined_signal(log), (30,)))
    return events.groupBy("event_type", "market").agg(
        F.count("*").alias("n"), F.sum("y_ed_30d").alias("y_ed"), F.sum("y_ip_30d").alias("y_ip"), F.sum("y_any_30d").alias("y_any"))


@query("k5_day_labels_30_60_90", r.sql(CLAIM_SIGNAL, body=f"SELECT {KEYS}{_label_sql((30, 60, 90), DAY_FRAME)} FROM signal"))
def k5(t):
    labels = ev.day_labels(claim_signal(t), (30, 60, 90))
    return labels.select("member_id", "event_date", *[f"y_{k}_{n}d" for n in (30, 60, 90) for k in ("ed", "ip", "any")])


@query("k5_row_labels_30_60_90", r.sql(CLAIM_SIGNAL, body=f"SELECT {KEYS}{_label_sql((30, 60, 90), ROW_FRAME)} FROM signal"))
def k5_rows(t):
    labels = ev.day_labels(claim_signal(t), (30, 60, 90), mode="rows")
    return labels.select("member_id", "event_date", *[f"y_{k}_{n}d" for n in (30, 60, 90) for k in ("ed", "ip", "any")])


@query("k6_same_day_themes", r.sql(CLAIM_SIGNAL, body="""
SELECT member_id, event_date,
       CASE WHEN (any_ed_on_date = 1 OR any_ip_on_date = 1) AND has_hiv = 1 THEN 1 ELSE 0 END AS y_hiv_day,
       CASE WHEN (any_ed_on_date = 1 OR any_ip_on_date = 1) AND has_smi = 1 THEN 1 ELSE 0 END AS y_smi_day,
       CASE WHEN (any_ed_on_date = 1 OR any_ip_on_date = 1) AND has_diabetes = 1 THEN 1 ELSE 0 END AS y_diabetes_day
FROM signal"""))
def k6(t):
    return ev.day_labels(claim_signal(t), ()).select("member_id", "event_date", "y_hiv_day", "y_smi_day", "y_diabetes_day")


# ---- look-ahead labels and windows on the feed ---------------------------------------------------------

@query("e1_label_next_7d", r.sql(FEED_SIGNAL, body=f"SELECT {KEYS}{_label_sql((7,), DAY_FRAME)} FROM daily"))
def e1(t):
    return ev.day_labels(ev.daily_signal(feed_log(t)), (7,))


@query("e1_label_next_7_rows", r.sql(FEED_SIGNAL, body=f"SELECT {KEYS}{_label_sql((7,), ROW_FRAME)} FROM daily"))
def e1_rows(t):
    return ev.day_labels(ev.daily_signal(feed_log(t)), (7,), mode="rows")


def feed_days(t):
    """One row per member-day of the feed: value as integer cents, error and purchase flags."""
    return r.feed(t).groupBy("member_id", F.col("admit_date").alias("event_date")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.count_if(F.col("event_type") == "purchase").alias("n_purchase"),
        F.max(F.when(F.col("event_type") == "signup", F.col("k"))).alias("signup_score"),
    )


FEED_DAYS = r.FEED + """,
days AS (
  SELECT member_id, admit_date AS event_date, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents,
         COUNT(*) FILTER (event_type = 'error') AS n_error, COUNT(*) FILTER (event_type = 'purchase') AS n_purchase,
         MAX(CASE WHEN event_type = 'signup' THEN k END) AS signup_score
  FROM feed GROUP BY 1, 2)"""
W_ROWS = "PARTITION BY member_id ORDER BY event_date ROWS BETWEEN %s"
W_DAYS = "PARTITION BY member_id ORDER BY event_date RANGE BETWEEN %s"


@query("e2_delta_to_mean", r.sql(FEED_DAYS, body=f"""
SELECT {KEYS}ROUND(cents - AVG(cents) OVER ({W_ROWS % "7 PRECEDING AND 1 PRECEDING"}), 4) AS delta_rows,
       ROUND(cents - AVG(cents) OVER ({W_DAYS % "INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"}), 4) AS delta_days
FROM days"""))
def e2(t):
    return feed_days(t).select(
        "member_id", "event_date", F.round(wn.delta_to_mean("cents", wn.trailing(7, "rows")), 4).alias("delta_rows"),
        F.round(wn.delta_to_mean("cents", wn.trailing(7, "days")), 4).alias("delta_days"),
    )


@query("e3_moving_sum", r.sql(FEED_DAYS, body=f"""
SELECT {KEYS}CAST(SUM(n_error + n_purchase) OVER ({W_ROWS % "7 PRECEDING AND 1 PRECEDING"}) AS BIGINT) AS sum_7_rows,
       CAST(SUM(n_error + n_purchase) OVER ({W_DAYS % "INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"}) AS BIGINT) AS sum_14_days
FROM days"""))
def e3(t):
    both = F.col("n_error") + F.col("n_purchase")
    return feed_days(t).select(
        "member_id", "event_date", F.sum(both).over(wn.trailing(7, "rows")).alias("sum_7_rows"),
        F.sum(both).over(wn.trailing(14, "days")).alias("sum_14_days"),
    )


@query("e4_trailing_flag", r.sql(FEED_DAYS, body=f"""
SELECT {KEYS}MAX(CASE WHEN n_error > 0 THEN 1 ELSE 0 END) OVER ({W_ROWS % "5 PRECEDING AND CURRENT ROW"}) AS any_error_6_rows,
       MAX(CASE WHEN n_error > 0 THEN 1 ELSE 0 END) OVER ({W_DAYS % "INTERVAL 5 DAY PRECEDING AND CURRENT ROW"}) AS any_error_5_days
FROM days"""))
def e4(t):
    hit = F.max(flag(F.col("n_error") > 0))
    return feed_days(t).select(
        "member_id", "event_date", hit.over(wn.trailing(5, "rows", True)).alias("any_error_6_rows"),
        hit.over(wn.trailing(5, "days", True)).alias("any_error_5_days"),
    )


@query("e5_state_transitions", r.sql(FEED_DAYS, body="""
, f AS (SELECT member_id, event_date, CASE WHEN n_purchase > 0 THEN 1 ELSE 0 END AS buys, cents FROM days)
SELECT member_id, event_date,
       CASE WHEN LAG(buys) OVER w = 0 AND buys = 1 THEN 1 ELSE 0 END AS started,
       CASE WHEN LAG(buys) OVER w = 1 AND buys = 0 THEN 1 ELSE 0 END AS stopped,
       cents - LAG(cents) OVER w AS change
FROM f WINDOW w AS (PARTITION BY member_id ORDER BY event_date)"""))
def e5(t):
    f = feed_days(t).withColumn("buys", flag(F.col("n_purchase") > 0))
    d = "event_date"
    return f.select("member_id", d, wn.turned("buys", 0, 1, date=d).alias("started"),
                    wn.turned("buys", 1, 0, date=d).alias("stopped"), wn.change("cents", date=d).alias("change"))


@query("e6_newly_positive", r.sql(FEED_DAYS, body="""
SELECT member_id, event_date,
       CASE WHEN n_purchase > 0 AND LAG(n_purchase, 5, 0) OVER (PARTITION BY member_id ORDER BY event_date) = 0 THEN 1 ELSE 0 END AS new_purchase
FROM days"""))
def e6(t):
    return feed_days(t).select("member_id", "event_date", wn.newly_positive("n_purchase", 5).alias("new_purchase"))


@query("e7_days_since_last", r.sql(FEED_DAYS, body="""
SELECT member_id, event_date,
       DATE_DIFF('day', MAX(CASE WHEN signup_score IS NOT NULL THEN event_date END)
         OVER (PARTITION BY member_id ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_date)::INTEGER AS days_since_signup
FROM days"""))
def e7(t):
    return feed_days(t).select("member_id", "event_date", wn.days_since_last("signup_score").alias("days_since_signup"))


@query("e8_group_means", r.sql(r.NOTE_SCORES, body="""
, k AS (SELECT n.*, LOWER(nation.n_name) AS market FROM note_scores n JOIN customer ON c_custkey = member_id JOIN nation ON n_nationkey = c_nationkey)
SELECT event_id, category, score,
       ROUND(AVG(score) OVER (PARTITION BY category), 6) AS population_baseline,
       ROUND(AVG(score) OVER (PARTITION BY market, category), 6) AS market_baseline,
       ROUND(AVG(score) OVER (PARTITION BY member_id, category), 6) AS individual_baseline
FROM k"""))
def e8(t):
    market = r.members(t).select("member_id", "market")
    scores = r.note_scores(t).join(market, "member_id")
    out = wn.with_group_means(scores, "score", {
        "population_baseline": ["category"], "market_baseline": ["market", "category"],
        "individual_baseline": ["member_id", "category"],
    })
    return out.select("event_id", "category", "score", *[
        F.round(c, 6).alias(c) for c in ("population_baseline", "market_baseline", "individual_baseline")
    ])


@query("e9_rank_over_count", r.sql(r.CLAIMS, body="""
SELECT place_of_service, provider_id, n, CAST(rn AS INTEGER) AS rn FROM (
  SELECT place_of_service, provider_id, COUNT(*) AS n,
         ROW_NUMBER() OVER (PARTITION BY place_of_service ORDER BY COUNT(*) DESC, provider_id) AS rn
  FROM claims GROUP BY 1, 2)"""))
def e9(t):
    counts = r.claims(t).groupBy("place_of_service", "provider_id").agg(F.count("*").alias("n"))
    return wn.ranked_in_groups(counts, ["place_of_service"], "n", ["provider_id"], "rn")


@query("e10_cumulative_distribution", """
WITH c AS (SELECT value, COUNT(*) AS n FROM events GROUP BY value)
SELECT value, n, ROUND(SUM(n) OVER (ORDER BY value) / SUM(n) OVER (), 9) AS cume_dist FROM c""")
def e10(t):
    return wn.cumulative_share(t.events, "value").withColumn("cume_dist", F.round("cume_dist", 9))


# ---- lookbacks -----------------------------------------------------------------------------------------

FEED_LOOKBACK = r.FEED + """,
anchors AS (SELECT DISTINCT member_id, admit_date AS event_date FROM feed)"""


@query("k7_lookback_7d", r.sql(FEED_LOOKBACK, body="""
SELECT a.member_id, a.event_date,
       CAST(COALESCE(SUM(CAST(f.value AS DECIMAL(31,9))), 0) AS DOUBLE) AS value_7d,
       COUNT(*) FILTER (f.event_type = 'error') AS n_error_7d,
       COUNT(DISTINCT CASE WHEN f.event_type = 'error' THEN f.admit_date END) AS error_days_7d,
       COUNT(DISTINCT CASE WHEN f.event_type = 'purchase' THEN f.admit_date END) AS purchase_days_7d
FROM anchors a LEFT JOIN feed f ON f.member_id = a.member_id AND f.admit_date >= a.event_date - 7 AND f.admit_date <= a.event_date - 2
GROUP BY 1, 2"""))
def k7_feed(t):
    feed = r.feed(t)
    kinds = F.col("event_type")
    return lb.day_lookback(None, feed, [
        lb.Measure("value", F.col("value")), lb.Measure("n_error", kinds == "error", "count"),
        lb.Measure("error_days", kinds == "error", "days"), lb.Measure("purchase_days", kinds == "purchase", "days"),
    ], [lb.DaySpan("7d", 7)], fact_date="admit_date", lag_days=2).withColumn("value_7d", F.col("value_7d").cast("double"))


def amounts_as_double(df):
    """Sums are exact decimals; the comparison run takes doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c.startswith("paid_sum")})


CLAIM_LOOKBACK = r.CLAIMS + f""",
flagged AS (SELECT *, {ED} AS ed, {IP} AS ip FROM claims),
anchors AS (SELECT DISTINCT member_id, service_date AS event_date FROM claims),
joined AS (
  SELECT a.member_id, a.event_date, c.service_date AS d, c.paid_amount, c.ed, c.ip
  FROM anchors a LEFT JOIN flagged c ON c.member_id = a.member_id AND c.service_date < a.event_date
   AND c.service_date >= a.event_date - 180
   AND c.service_date <= CAST(a.event_date - INTERVAL 4 MONTH AS DATE))"""


@query("k7_claim_lookback_lag4", r.sql(CLAIM_LOOKBACK, body="""
SELECT member_id, event_date,
       CAST(COALESCE(SUM(CASE WHEN d >= event_date - 90 THEN paid_amount END), 0) AS DOUBLE) AS paid_sum_90d,
       COUNT(DISTINCT CASE WHEN ed AND d >= event_date - 90 THEN d END) AS cnt_ed_visits_90d,
       COUNT(DISTINCT CASE WHEN ip AND d >= event_date - 90 THEN d END) AS cnt_ip_visits_90d,
       CAST(COALESCE(SUM(paid_amount), 0) AS DOUBLE) AS paid_sum_180d,
       COUNT(DISTINCT CASE WHEN ed THEN d END) AS cnt_ed_visits_180d,
       COUNT(DISTINCT CASE WHEN ip THEN d END) AS cnt_ip_visits_180d,
       CAST(COALESCE(SUM(CASE WHEN d < event_date - 90 THEN paid_amount END), 0) AS DOUBLE) AS paid_sum_90_180d,
       COUNT(DISTINCT CASE WHEN ed AND d < event_date - 90 THEN d END) AS cnt_ed_visits_90_180d,
       COUNT(DISTINCT CASE WHEN ip AND d < event_date - 90 THEN d END) AS cnt_ip_visits_90_180d
FROM joined GROUP BY 1, 2"""))
def k7_claims(t):
    return amounts_as_double(dy.claim_lookback(None, r.claims(t), lag_months=4))


@query("c9_range_join_days", r.sql(r.CLAIMS, body=f"""
, flagged AS (SELECT *, {ED} AS ed, {IP} AS ip FROM claims), anchors AS (SELECT DISTINCT member_id, service_date AS event_date FROM claims)
SELECT a.member_id, a.event_date, COUNT(c.claim_id) AS cnt_outpatient_90_180d
FROM anchors a LEFT JOIN flagged c ON c.member_id = a.member_id AND NOT (c.ed OR c.ip)
 AND c.service_date < a.event_date - 90 AND c.service_date >= a.event_date - 180
 AND c.service_date <= CAST(a.event_date - INTERVAL 4 MONTH AS DATE)
GROUP BY 1, 2"""))
def c9(t):
    claims = r.claims(t)
    quiet = ~(ev.is_ed_line("place_of_service", "revenue_code") | ev.is_ip_line("place_of_service", "revenue_code"))
    return lb.day_lookback(None, claims, [lb.Measure("cnt_outpatient", quiet, "count")],
                           [lb.DaySpan("90_180d", 180, 91)], fact_date="service_date", lag_months=4)


MPR = r.FILLS + """,
anchors AS (SELECT DISTINCT member_id, filled_date AS event_date FROM fills),
joined AS (
  SELECT a.member_id, a.event_date, f.filled_date AS d, f.drug_type, f.days_supply
  FROM anchors a LEFT JOIN fills f ON f.member_id = a.member_id AND f.filled_date < a.event_date AND f.days_supply > 0
   AND f.filled_date >= a.event_date - 180 AND f.filled_date <= CAST(a.event_date - INTERVAL 2 MONTH AS DATE))"""


@query("k8_possession_ratio", r.sql(MPR, body="SELECT member_id, event_date, " + ", ".join(
    f"ROUND(COALESCE(SUM(CASE WHEN drug_type = '{k}' AND d >= event_date - {n} THEN days_supply END), 0) / {n}.0::DOUBLE, 9) AS mpr_{v}_{n}d"
    for n in (90, 180) for k, v in r.TYPE_CLASS.items()) + " FROM joined GROUP BY 1, 2"))
def k8(t):
    out = lb.possession_ratio(None, r.fills(t), {c: F.col(f"is_{c}") for c in codes.DAILY_DRUG_CLASSES}, (90, 180), lag_months=2)
    return out.select("member_id", "event_date", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("mpr_")])


@query("k9_merged_counts", r.sql(CLAIM_LOOKBACK, body="""
, c AS (SELECT member_id, event_date, COUNT(DISTINCT CASE WHEN ed THEN d END) AS n FROM joined GROUP BY 1, 2 HAVING COUNT(d) > 0),
o AS (SELECT DISTINCT o_custkey AS member_id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT'),
rt AS (SELECT a.member_id, a.event_date, COUNT(o.d) AS n FROM anchors a JOIN o ON o.member_id = a.member_id AND o.d < a.event_date AND o.d >= a.event_date - 180 GROUP BY 1, 2)
SELECT a.member_id, a.event_date, COALESCE(c.n, 0) + COALESCE(rt.n, 0) AS cnt_ed_visits_180d
FROM anchors a LEFT JOIN c ON c.member_id = a.member_id AND c.event_date = a.event_date
LEFT JOIN rt ON rt.member_id = a.member_id AND rt.event_date = a.event_date"""))
def k9(t):
    claims = r.claims(t)
    anchors = claims.select("member_id", F.col("service_date").alias("event_date")).distinct()
    lagged = lb.day_lookback(anchors, claims, [lb.Measure("c", ev.is_ed_line("place_of_service", "revenue_code"), "days")],
                             [lb.DaySpan("180d", 180)], fact_date="service_date", lag_months=4)
    prompt = t.orders.select(F.col("o_custkey").alias("member_id"), F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    current = lb.day_lookback(anchors, prompt, [lb.Measure("rt", F.col("o_orderpriority") == "1-URGENT", "days")],
                              [lb.DaySpan("180d", 180)], fact_date="d")
    return lagged.join(current, ["member_id", "event_date"]).select(
        "member_id", "event_date", lb.merged_counts("c_180d", "rt_180d").alias("cnt_ed_visits_180d"))


@query("c11_followup_join", r.sql(r.CONTACTS, body="""
SELECT a.member_id, a.event_date, MIN(b.contact_date) AS first_followup
FROM (SELECT DISTINCT member_id, contact_date AS event_date FROM contacts WHERE status = 'unsuccessful') a
LEFT JOIN contacts b ON b.member_id = a.member_id AND b.status = 'successful' AND b.contact_date BETWEEN a.event_date AND a.event_date + 60
GROUP BY 1, 2"""))
def c11(t):
    contacts = r.contacts(t).withColumnRenamed("contact_date", "event_date")
    return lb.first_followup(contacts.where("status = 'unsuccessful'"), contacts.where("status = 'successful'"), 60)


# ---- member-day assembly -------------------------------------------------------------------------------

NOTE_DAY = r.NOTE_SCORES + """,
notes AS (
  SELECT member_id, note_date AS event_date,
         MAX(CASE WHEN category = 'HEALTH' THEN score END) AS note_health_score,
         MAX(CASE WHEN category = 'RISK_HARM' THEN score END) AS note_risk_harm_score,
         MAX(CASE WHEN category = 'SOCIAL_STABILITY' THEN score END) AS note_social_stab_score,
         MAX(CASE WHEN category = 'MED_ADHERENCE' THEN score END) AS note_med_adherence_score,
         MAX(CASE WHEN category = 'CARE_ENGAGEMENT' THEN score END) AS note_care_engagement_score,
         MAX(CASE WHEN category = 'PROGRAM_TRUST' THEN score END) AS note_program_trust_score,
         MAX(CASE WHEN category = 'SELF' THEN score END) AS note_self_score
  FROM note_scores GROUP BY 1, 2)"""


def note_days(t):
    return dy.note_pivot(r.note_scores(t).withColumnRenamed("note_date", "event_date"))


@query("d5_pivot_note_scores", r.sql(NOTE_DAY, body="SELECT * FROM notes"))
def d5(t):
    return note_days(t)


def feed_counts():
    return {"cnt_ed": (F.col("event_type") == "error", "days"), "cnt_click": (F.col("event_type") == "click", "count")}


def feed_features(t):
    """Note scores of the day with short windows of the feed's own counts."""
    counts = lb.day_lookback(None, r.feed(t), [lb.Measure(n, condition, kind) for n, (condition, kind) in feed_counts().items()],
                             [lb.DaySpan("7d", 7)], fact_date="admit_date")
    return counts.join(note_days(t), ["member_id", "event_date"], "left")


FEED_FEATURES = NOTE_DAY + """,
anchors AS (SELECT DISTINCT member_id, admit_date AS event_date FROM feed),
counts AS (
  SELECT a.member_id, a.event_date, COUNT(DISTINCT CASE WHEN f.event_type = 'error' THEN f.admit_date END) AS cnt_ed_7d,
         COUNT(*) FILTER (f.event_type = 'click') AS cnt_click_7d
  FROM anchors a LEFT JOIN feed f ON f.member_id = a.member_id AND f.admit_date BETWEEN a.event_date - 7 AND a.event_date - 1
  GROUP BY 1, 2),
features AS (
  SELECT c.*, note_health_score, note_risk_harm_score, note_social_stab_score, note_med_adherence_score,
         note_care_engagement_score, note_program_trust_score, note_self_score
  FROM counts c LEFT JOIN notes n ON n.member_id = c.member_id AND n.event_date = c.event_date)"""


@query("k10_inconsistency_flags", r.sql(FEED_FEATURES, body=f"""
SELECT {KEYS}
  MAX(CASE WHEN note_med_adherence_score > 3 AND cnt_ed_7d < 2 THEN 1 ELSE 0 END) OVER ({W_ROWS % "60 PRECEDING AND CURRENT ROW"}) AS inconsistency_med_noncompliance,
  MAX(CASE WHEN note_care_engagement_score > 0.5 AND cnt_click_7d = 0 THEN 1 ELSE 0 END) OVER ({W_ROWS % "60 PRECEDING AND CURRENT ROW"}) AS inconsistency_appt_noncompliance
FROM features"""))
def k10(t):
    f = feed_features(t)
    return dy.with_inconsistency(f, {
        "inconsistency_med_noncompliance": (F.col("note_med_adherence_score") > 3) & (F.col("cnt_ed_7d") < 2),
        "inconsistency_appt_noncompliance": (F.col("note_care_engagement_score") > 0.5) & (F.col("cnt_click_7d") == 0),
    }, 60, "rows").select("member_id", "event_date", "inconsistency_med_noncompliance", "inconsistency_appt_noncompliance")


@query("k11_member_day_table", r.sql(FEED_FEATURES, r.MEMBERS, body=f"""
, daily AS (
  SELECT member_id, admit_date AS event_date, MAX(CASE WHEN setting = 'ED' THEN 1 ELSE 0 END) AS any_ed_on_date,
         MAX(CASE WHEN setting = 'Inpatient' THEN 1 ELSE 0 END) AS any_ip_on_date FROM feed GROUP BY 1, 2),
labels AS (SELECT {KEYS}{_label_sql((7, 14), DAY_FRAME)} FROM daily)
SELECT f.*, m.market, m.dob, m.gender, {", ".join(f"COALESCE(y_{k}_{n}d, 0) AS y_{k}_{n}d" for n in (7, 14) for k in ("ed", "ip", "any"))}
FROM features f JOIN members m ON m.member_id = f.member_id
LEFT JOIN labels l ON l.member_id = f.member_id AND l.event_date = f.event_date"""))
def k11(t):
    days = dy.feed_days(r.scored_feed(t), (7, 14), feed_counts())
    return days.join(r.members(t).select("member_id", "market", "dob", "gender"), "member_id")


@query("k12_longitudinal", r.sql(FEED_FEATURES, body=f"""
SELECT {KEYS}
  ROUND(note_health_score - AVG(note_health_score) OVER ({W_ROWS % "30 PRECEDING AND 1 PRECEDING"}), 6) AS note_health_delta,
  ROUND(note_risk_harm_score - AVG(note_risk_harm_score) OVER ({W_ROWS % "30 PRECEDING AND 1 PRECEDING"}), 6) AS note_risk_harm_delta,
  DATE_DIFF('day', MAX(CASE WHEN note_health_score IS NOT NULL THEN event_date END) OVER ({W_ROWS % "UNBOUNDED PRECEDING AND 1 PRECEDING"}), event_date)::INTEGER AS days_since_health,
  CAST(SUM(cnt_ed_7d) OVER ({W_ROWS % "30 PRECEDING AND 1 PRECEDING"}) AS BIGINT) AS cnt_ed_7d_rolling,
  CASE WHEN cnt_click_7d > 0 AND LAG(cnt_click_7d, 5, 0) OVER (PARTITION BY member_id ORDER BY event_date) = 0 THEN 1 ELSE 0 END AS cnt_click_7d_new
FROM features"""))
def k12(t):
    out = dy.longitudinal(feed_features(t), deltas={"note_health_score": "note_health_delta", "note_risk_harm_score": "note_risk_harm_delta"},
                          since={"note_health_score": "days_since_health"}, rolling={"cnt_ed_7d": "cnt_ed_7d_rolling"},
                          new={"cnt_click_7d": "cnt_click_7d_new"}, n=30, n_new=5, mode="rows")
    return out.select("member_id", "event_date", F.round("note_health_delta", 6).alias("note_health_delta"),
                      F.round("note_risk_harm_delta", 6).alias("note_risk_harm_delta"), "days_since_health",
                      "cnt_ed_7d_rolling", "cnt_click_7d_new")


@query("k13_first_occurrence", r.sql(CLAIM_SIGNAL, body="""
, firsts AS (
  SELECT member_id, MIN(CASE WHEN has_diabetes > 0 THEN event_date END) AS first_diabetes_date,
         MIN(CASE WHEN has_smi > 0 THEN event_date END) AS first_smi_date FROM signal GROUP BY 1)
SELECT s.member_id, s.event_date,
       DATE_DIFF('month', first_diabetes_date, s.event_date)::INTEGER AS months_since_first_diabetes,
       DATE_DIFF('month', first_smi_date, s.event_date)::INTEGER AS months_since_first_smi
FROM signal s JOIN firsts f ON f.member_id = s.member_id"""))
def k13(t):
    return dy.months_since_first(claim_signal(t).select("member_id", "event_date", "has_diabetes", "has_smi"),
                                 {"diabetes": "has_diabetes", "smi": "has_smi"}).drop("has_diabetes", "has_smi")


@query("k14_intervention_period", r.sql(NOTE_DAY, r.MEMBERS, body="""
, first_note AS (SELECT member_id, MIN(event_date) AS first_note_date FROM notes WHERE note_health_score IS NOT NULL GROUP BY 1)
SELECT n.member_id, n.event_date,
       CASE WHEN m.has_ever_been_engaged AND n.event_date >= first_note_date THEN 1 ELSE 0 END AS has_care_notes_post_period
FROM notes n JOIN members m ON m.member_id = n.member_id LEFT JOIN first_note f ON f.member_id = n.member_id"""))
def k14(t):
    engaged = r.members(t).select("member_id", F.expr("has_ever_been_engaged").alias("engaged"))
    days = note_days(t).join(engaged, "member_id")
    return dy.with_intervention_period(days, "note_health_score", F.col("engaged")).select(
        "member_id", "event_date", "has_care_notes_post_period")


@query("c13_snapshot_year_join", r.sql(r.CLAIMS, body="""
, raf AS (SELECT o_custkey AS member_id, YEAR(o_orderdate) AS payment_year, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS payer_score FROM orders GROUP BY 1, 2)
SELECT c.member_id, c.claim_id, c.claim_line_number, COALESCE(raf.payer_score, 1.5) AS payer_score
FROM claims c LEFT JOIN raf ON raf.member_id = c.member_id AND YEAR(c.service_date) = raf.payment_year - 1"""))
def c13(t):
    snapshot = t.orders.groupBy(F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("payment_year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("payer_score"))
    joined = dy.with_snapshot(r.claims(t), snapshot, ["payer_score"], date="service_date")
    return joined.select("member_id", "claim_id", "claim_line_number", "payer_score")


# ---- the whole chain -----------------------------------------------------------------------------------

#: Claim lines for which the chain has a task, at most: a line gives several events of many columns.
CHAIN_ROWS = 250_000


@contextmanager
def chained(t):
    """While the stages of the chain are written: all by member, in as many tasks as the claim lines ask for."""
    with shuffled_by_rows(t.lineitem, CHAIN_ROWS), co_partitioned(t.spark), wide_rows(t.spark):
        yield


def kept_days(days):
    return kept_in_place(days, "member-days", "member_id", ["event_date"], "zstd")


def located_log(t, s, extra=()):
    """The full log from claim lines that lie by member: only the small feeds are moved. ``extra`` columns stand beside its shape."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    lines = r.claims(s)
    return kept_in_place(ev.event_log([
        ev.diagnosis_events(lines, r.diagnoses(s), located=True), ev.line_events(lines), ev.fill_events(r.fills(s)),
        ev.admission_events(r.feed(t).repartition(n, "member_id"), "ADT", "adt"), ev.note_events(r.note_scores(t).repartition(n, "member_id")),
    ], extra=extra), "event-log", "member_id", compression="zstd")


def chain_days(t):
    """Member-days of the whole chain. Lines and log lie together by member, so the log is reduced, looked back on and labelled there."""
    members = ev.cohort(r.members(t), None, F.lit(ASOF).cast("date")).select(
        "member_id", "market", "dob", "gender", "engagement_group", "normalized_coverage", "months_since_batched")
    s = r.member_lines(t, lambda parts: ev.mapped_diagnoses(parts, r.code_map(t)))
    return stages.member_days(located_log(t, s, [ev.SUPPLY]), None, members)


CHAIN = FULL_LOG + """,
idx AS (SELECT DISTINCT member_id, event_date FROM full_log),
look AS (
  SELECT i.member_id, i.event_date, CAST(COALESCE(SUM(paid_amount), 0) AS DOUBLE) AS paid_sum_180d,
         COUNT(DISTINCT CASE WHEN is_ed_event THEN c.event_date END) AS cnt_ed_visits_180d,
         COUNT(*) FILTER (has_diabetes > 0) AS cnt_hcc_diabetes_180d, COUNT(hcc_category) AS cnt_any_hcc_180d,
         COUNT(*) FILTER (c.event_date < i.event_date - 90 AND NOT (is_ed_event OR is_ip_event)) AS cnt_outpatient_90_180d
  FROM idx i LEFT JOIN log c ON c.member_id = i.member_id AND c.event_type LIKE 'CLAIM_%' AND c.event_date < i.event_date
   AND c.event_date >= i.event_date - 180 AND c.event_date <= CAST(i.event_date - INTERVAL 4 MONTH AS DATE)
  GROUP BY 1, 2),
mpr AS (
  SELECT i.member_id, i.event_date, COALESCE(SUM(CASE WHEN drug_type = 'ECONOMY' THEN days_supply END), 0) / 180.0::DOUBLE AS mpr_insulin_180d,
         COUNT(*) FILTER (drug_type = 'LARGE') AS cnt_fills_opioid_180d,
         COALESCE(SUM(CASE WHEN drug_type = 'SMALL' AND f.filled_date >= i.event_date - 90 THEN days_supply END), 0) / 90.0::DOUBLE AS mpr_antipsychotic_90d
  FROM idx i LEFT JOIN fills f ON f.member_id = i.member_id AND f.days_supply > 0 AND f.filled_date < i.event_date
   AND f.filled_date >= i.event_date - 180 AND f.filled_date <= CAST(i.event_date - INTERVAL 2 MONTH AS DATE)
  GROUP BY 1, 2),
adt AS (
  SELECT i.member_id, i.event_date, COUNT(DISTINCT CASE WHEN setting = 'ED' THEN admit_date END) AS cnt_ed_adt_180d,
         COUNT(DISTINCT CASE WHEN setting = 'Inpatient' AND admit_date >= i.event_date - 90 THEN admit_date END) AS cnt_ip_adt_90d
  FROM idx i LEFT JOIN feed f ON f.member_id = i.member_id AND f.admit_date BETWEEN i.event_date - 180 AND i.event_date - 1 GROUP BY 1, 2),
note_day AS (
  SELECT member_id, event_date, MAX(CASE WHEN code = 'HEALTH' THEN score END) AS note_health_score,
         MAX(CASE WHEN code = 'MED_ADHERENCE' THEN score END) AS note_med_adherence_score
  FROM full_log WHERE event_type = 'CARE_NOTE' GROUP BY 1, 2),
full_daily AS (
  SELECT member_id, event_date, MAX(CASE WHEN is_ed_event THEN 1 ELSE 0 END) AS any_ed_on_date,
         MAX(CASE WHEN is_ip_event THEN 1 ELSE 0 END) AS any_ip_on_date FROM full_log GROUP BY 1, 2),
day_label AS (SELECT """ + KEYS + _label_sql((30, 60, 90), DAY_FRAME) + """ FROM full_daily),
wide AS (
  SELECT l.member_id, l.event_date, paid_sum_180d, cnt_ed_visits_180d + cnt_ed_adt_180d AS cnt_ed_visits_180d, cnt_ip_adt_90d,
         cnt_hcc_diabetes_180d, cnt_any_hcc_180d, cnt_outpatient_90_180d, ROUND(mpr_insulin_180d, 9) AS mpr_insulin_180d,
         cnt_fills_opioid_180d, m.market, note_health_score, COALESCE(y_ed_30d, 0) AS y_ed_30d, COALESCE(y_ip_60d, 0) AS y_ip_60d,
         COALESCE(y_any_90d, 0) AS y_any_90d,
         CASE WHEN note_med_adherence_score > 3 AND mpr_antipsychotic_90d < 0.2 THEN 1 ELSE 0 END AS doubtful
  FROM look l JOIN mpr USING (member_id, event_date) JOIN adt USING (member_id, event_date) JOIN members m ON m.member_id = l.member_id
  LEFT JOIN note_day USING (member_id, event_date) LEFT JOIN day_label USING (member_id, event_date)
  WHERE m.market IS NOT NULL),
chain AS (
  SELECT * EXCLUDE (doubtful), MAX(doubtful) OVER (PARTITION BY member_id ORDER BY event_date
    RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW) AS inconsistency_med_noncompliance FROM wide)"""


@query("k7_event_log_chain", r.sql(r.MEMBERS, CHAIN, body="SELECT * FROM chain"))
def k7_chain(t):
    with chained(t):
        return kept_days(chain_days(t).select(
            "member_id", "event_date", F.col("paid_sum_180d").cast("double").alias("paid_sum_180d"), "cnt_ed_visits_180d", "cnt_ip_adt_90d",
            "cnt_hcc_diabetes_180d", "cnt_any_hcc_180d", "cnt_outpatient_90_180d", F.round("mpr_insulin_180d", 9).alias("mpr_insulin_180d"),
            "cnt_fills_opioid_180d", "market", "note_health_score", "y_ed_30d", "y_ip_60d", "y_any_90d", "inconsistency_med_noncompliance"))


@query("k11_modelling_rows")
def k11_modelling(t):
    snapshot = t.orders.groupBy(F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("payment_year")).agg(
        F.count("*").cast("double").alias("payer_score"))
    with chained(t):
        return stored(stages.modelling_rows(kept_days(chain_days(t)), snapshot), "modelling-rows", compression="zstd")
