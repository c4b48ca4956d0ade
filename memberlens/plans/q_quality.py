"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.functions.expr import engagement_group, gender_flags
from memberlens.operators import cohort as co
from memberlens.operators import quality as ql
from memberlens.operators import tabular as tb
from memberlens.plans import q_history as qh
from memberlens.plans import q_months as qm
from memberlens.plans import roles as r
from memberlens.plans.catalogue_sql import member_day_sql
from memberlens.plans.registry import query

LABELS = [f"y_{k}_{n}d" for n in (7, 14) for k in ("ed", "ip", "any")]


def days(t):
    return qh.k11(t)


@query("m1_null_counts", member_day_sql("""
SELECT column_name, null_count FROM (UNPIVOT (SELECT COUNT(*) FILTER (note_health_score IS NULL) AS note_health_score, COUNT(*) FILTER (market IS NULL) AS market,
  COUNT(*) FILTER (y_any_7d IS NULL) AS y_any_7d FROM day_table) ON note_health_score, market, y_any_7d INTO NAME column_name VALUE null_count)"""))
def m1(t):
    return ql.null_counts(days(t), ["note_health_score", "market", "y_any_7d"])


@query("m2_duplicate_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS record_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def m2(t):
    return tb.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("m3_rule_breaches", """
SELECT 'negative_balance' AS rule, COUNT(*) FILTER (c_acctbal < 0) AS invalid_record_count FROM customer
UNION ALL SELECT 'balance_over_9000', COUNT(*) FILTER (c_acctbal > 9000) FROM customer""")
def m3(t):
    return ql.rule_breaches(t.customer, {"negative_balance": F.col("c_acctbal") < 0, "balance_over_9000": F.col("c_acctbal") > 9000})


@query("m4_one_hot_sums", """
WITH f AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS m, CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS f FROM customer)
SELECT 'two_genders' AS rule, COUNT(*) FILTER (m + f <> 1) AS invalid_record_count FROM f UNION ALL SELECT 'all_genders', 0 FROM f GROUP BY 1""")
def m4(t):
    flags = t.customer.select(*gender_flags("c_mktsegment"))
    return ql.one_hot_breaches(flags, {"two_genders": ["is_male", "is_female"], "all_genders": ["is_male", "is_female", "is_gender_unknown"]})


@query("m5_split_leaks", """
WITH s AS (SELECT o_custkey AS member_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'TRAIN' ELSE 'TEST' END AS dataset_split FROM orders)
SELECT member_id, COUNT(DISTINCT dataset_split) AS splits FROM s GROUP BY 1 HAVING COUNT(DISTINCT dataset_split) > 1""")
def m5(t):
    by_row = t.orders.select(F.col("o_custkey").alias("member_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "TRAIN").otherwise("TEST").alias("dataset_split"))
    return ql.split_leaks(by_row)


@query("m6_constant_features", """
SELECT column_name, ROUND(STDDEV_SAMP(v), 6) AS deviation, COALESCE(STDDEV_SAMP(v), 0) = 0 AS is_constant
FROM (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'always_one', 1.0 FROM lineitem) GROUP BY 1""")
def m6(t):
    out = ql.constant_features(t.lineitem.select("l_quantity", F.lit(1.0).alias("always_one")), ["l_quantity", "always_one"])
    return out.withColumn("deviation", F.round("deviation", 6))


@query("m7_allowed_values", """
SELECT 'quality' AS column_name, COUNT(*) FILTER (quality NOT IN (0, 1)) AS invalid_count FROM labels UNION ALL SELECT 'toxic', COUNT(*) FILTER (toxic NOT IN (0, 1)) FROM labels
UNION ALL SELECT 'doc_id', COUNT(*) FILTER (doc_id NOT IN (0, 1)) FROM labels""")
def m7(t):
    return ql.invalid_values(t.labels, ["quality", "toxic", "doc_id"])


@query("m8_latency", """
SELECT MIN(DATE '2000-01-01' - CAST(o_orderdate AS DATE))::INTEGER AS min_days_latency, ROUND(AVG(DATE '2000-01-01' - CAST(o_orderdate AS DATE)), 6) AS avg_days_latency,
       MAX(DATE '2000-01-01' - CAST(o_orderdate AS DATE))::INTEGER AS max_days_latency, COUNT(*) FILTER (CAST(o_orderdate AS DATE) > DATE '2000-01-01') AS future_event_dates FROM orders""")
def m8(t):
    out = ql.latency(t.orders.select(F.to_date("o_orderdate").alias("event_date")), "event_date", "2000-01-01")
    return out.withColumn("avg_days_latency", F.round("avg_days_latency", 6))


@query("m9_distribution", """
SELECT event_type, COUNT(*) AS row_count, COUNT(DISTINCT user_id) AS unique_members, MIN(CAST(ts AS DATE)) AS first_date, MAX(CAST(ts AS DATE)) AS last_date FROM events GROUP BY 1""")
def m9(t):
    return ql.distribution(t.events.withColumn("d", F.to_date("ts")), ["event_type"], "d", "user_id")


@query("m9_members_by_market", r.sql(r.MEMBERS, body="""
SELECT market, CASE WHEN has_ever_been_engaged THEN 'engaged_in_program' WHEN is_batched THEN 'selected_not_engaged' ELSE 'not_selected_for_engagement' END AS engagement_group,
       COUNT(*) AS row_count, COUNT(DISTINCT member_id) AS unique_members, MIN(first_selected_date) AS first_date, MAX(first_selected_date) AS last_date FROM members GROUP BY 1, 2"""))
def m9_market(t):
    members = r.members(t).withColumn("engagement_group", engagement_group("has_ever_been_engaged", "is_batched"))
    return ql.distribution(members, ["market", "engagement_group"], "first_selected_date")


@query("m9_market_rollup", r.sql(r.MEMBERS, body="""
, g AS (SELECT COALESCE(market, 'unknown') AS market, CASE WHEN has_ever_been_engaged THEN 'engaged_in_program' WHEN is_batched THEN 'selected_not_engaged' ELSE 'not_selected_for_engagement' END AS engagement_group,
        member_id, first_selected_date FROM members)
SELECT CASE WHEN GROUPING(market) = 1 THEN 'all' ELSE market END AS market, CASE WHEN GROUPING(engagement_group) = 1 THEN 'all' ELSE engagement_group END AS engagement_group,
       (GROUPING(market) + GROUPING(engagement_group))::INTEGER AS level, COUNT(*) AS unique_members, COUNT(first_selected_date) AS selected_members,
       MIN(first_selected_date) AS first_date, MAX(first_selected_date) AS last_date
FROM g GROUP BY ROLLUP (market, engagement_group)"""))
def m9_rollup(t):
    """Members by market and engagement, with totals per market and of all; members are one row each."""
    members = r.members(t).withColumn("engagement_group", engagement_group("has_ever_been_engaged", "is_batched"))
    return tb.rolled_up(members, ["market", "engagement_group"], [
        F.count("*").alias("unique_members"), F.count("first_selected_date").alias("selected_members"),
        F.min("first_selected_date").alias("first_date"), F.max("first_selected_date").alias("last_date")])


@query("m10_monthly_by_source", r.sql(qh.LOG, body="""
SELECT YEAR(event_date)::INTEGER AS event_year, MONTH(event_date)::INTEGER AS event_month, CASE WHEN event_type = 'PHARMACY_FILL' THEN 'FILLS' WHEN event_type LIKE 'CLAIM%' THEN 'CLAIMS' END AS source_category,
       COUNT(*) FILTER (is_ip_event) AS total_ip_events, COUNT(*) FILTER (is_ed_event) AS total_ed_events, COUNT(DISTINCT member_id) AS unique_individuals FROM log GROUP BY 1, 2, 3"""))
def m10(t):
    kind = F.col("event_type")
    source = F.when(kind == "PHARMACY_FILL", "FILLS").when(kind.like("CLAIM%"), "CLAIMS")
    return ql.monthly_by_source(qh.claim_log(t), source, {"total_ip_events": F.col("is_ip_event"), "total_ed_events": F.col("is_ed_event")})


@query("m11_control_counts", r.sql(r.MEMBERS, r.CLAIMS, r.CONTACTS, body="""
SELECT 'members' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT member_id) AS unique_members FROM members UNION ALL
SELECT 'claims', COUNT(*), COUNT(DISTINCT member_id) FROM claims UNION ALL SELECT 'contacts', COUNT(*), COUNT(DISTINCT member_id) FROM contacts"""))
def m11(t):
    return co.control_counts({"members": r.members(t), "claims": r.claims(t), "contacts": r.contacts(t)})


@query("m11_control_flags", r.sql(qm.SPANS, r.MEMBERS, qm.PRODUCTS, body="""
SELECT 'unique_members' AS flag, COUNT(DISTINCT member_id) AS value FROM spans UNION ALL
SELECT 'unique_disenrolled_members', COUNT(DISTINCT member_id) FROM spans WHERE is_disenrolled = 1 UNION ALL
SELECT 'auto_members', COUNT(DISTINCT member_id) FROM products WHERE is_auto = 1"""))
def m11_flags(t):
    spans = qm.spans(t)
    products = qm.mo.product_and_market_flags(r.members(t), qm.MARKETS, qm.PREFIXES)
    return ql.control_flags({
        "unique_members": (spans, F.lit(True)), "unique_disenrolled_members": (spans, F.col("is_disenrolled") == 1),
        "auto_members": (products, F.col("is_auto") == 1)})


BROKEN = """, broken AS (
  SELECT CASE WHEN member_id % 50 = 0 THEN NULL ELSE member_id END AS member_id, event_date, CASE WHEN member_id % 40 = 1 THEN 7 ELSE y_any_7d END AS y_any_7d,
         CASE WHEN member_id % 30 = 2 THEN NULL ELSE y_ed_7d END AS y_ed_7d FROM day_table
  UNION ALL SELECT member_id, event_date, y_any_7d, y_ed_7d FROM day_table WHERE member_id % 60 = 3)"""


def broken_days(t):
    """Member-days with missing keys, odd and missing labels and repeated rows, all by rule."""
    member = F.col("member_id")
    whole = days(t).select("member_id", "event_date", "y_any_7d", "y_ed_7d")
    spoilt = whole.select(
        F.when(member % 50 != 0, member).alias("member_id"), "event_date",
        F.when(member % 40 == 1, 7).otherwise(F.col("y_any_7d")).alias("y_any_7d"), F.when(member % 30 != 2, F.col("y_ed_7d")).alias("y_ed_7d"))
    return spoilt.unionByName(whole.where(member % 60 == 3))


@query("m12_suite_of_broken_days", member_day_sql(BROKEN + """
, found AS (
  SELECT 'null_keys' AS "check", COUNT(*) FILTER (member_id IS NULL OR event_date IS NULL) AS n FROM broken UNION ALL
  SELECT 'null_labels', COUNT(*) FILTER (y_any_7d IS NULL OR y_ed_7d IS NULL) FROM broken UNION ALL
  SELECT 'invalid_labels', COUNT(*) FILTER (COALESCE(y_any_7d, 0) NOT IN (0, 1) OR COALESCE(y_ed_7d, 0) NOT IN (0, 1)) FROM broken UNION ALL
  SELECT 'future_dates', COUNT(*) FILTER (event_date > DATE '2024-01-15') FROM broken UNION ALL
  SELECT 'duplicate_keys', COUNT(*) FROM (SELECT member_id, event_date FROM broken GROUP BY 1, 2 HAVING COUNT(*) > 1))
SELECT "check", CASE WHEN n = 0 THEN 'OK' ELSE 'ISSUES FOUND' END AS status, n AS n_findings FROM found"""))
def m12_broken(t):
    return ql.checked_member_days(broken_days(t), "broken-days", ["y_any_7d", "y_ed_7d"], asof="2024-01-15")[1]


@query("m12_suite", member_day_sql("""
, d AS (SELECT COUNT(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)), o AS (SELECT COUNT(DISTINCT o_orderstatus) AS n FROM orders),
found AS (
  SELECT 'null_keys' AS "check", COUNT(*) FILTER (member_id IS NULL OR event_date IS NULL) AS n FROM day_table UNION ALL
  SELECT 'null_labels', COUNT(*) FILTER (y_any_7d IS NULL OR y_ed_7d IS NULL OR y_ip_7d IS NULL OR y_any_14d IS NULL) FROM day_table UNION ALL
  SELECT 'invalid_labels', COUNT(*) FILTER (y_any_7d NOT IN (0, 1) OR y_ed_7d NOT IN (0, 1) OR y_ip_7d NOT IN (0, 1) OR y_any_14d NOT IN (0, 1)) FROM day_table UNION ALL
  SELECT 'future_dates', COUNT(*) FILTER (event_date > DATE '2024-12-31') FROM day_table UNION ALL
  SELECT 'duplicate_keys', COUNT(*) FROM (SELECT member_id, event_date FROM day_table GROUP BY 1, 2 HAVING COUNT(*) > 1) UNION ALL
  SELECT 'line_keys', n FROM d UNION ALL SELECT 'statuses', n FROM o)
SELECT "check", CASE WHEN "check" = 'statuses' THEN 'INFO' WHEN n = 0 THEN 'OK' ELSE 'ISSUES FOUND' END AS status, n AS n_findings FROM found"""))
def m12(t):
    others = ql.run_suite([
        ql.Check("line_keys", tb.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])),
        ql.Check("statuses", t.orders.select("o_orderstatus").distinct(), informational=True)])
    return ql.checked_member_days(days(t), "member-days", LABELS, asof="2024-12-31")[1].unionByName(others)


@query("m13_positive_days", member_day_sql("""
SELECT COUNT(*) FILTER (y_any_7d = 1) AS positive_y_any_7d_days, COUNT(*) FILTER (y_ed_7d = 1) AS positive_y_ed_7d_days, COUNT(*) AS total_unique_days FROM day_table"""))
def m13(t):
    return ql.positive_days(days(t), ["y_any_7d", "y_ed_7d"])
