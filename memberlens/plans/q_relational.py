"""Scans, projections, joins, aggregates, top-k, set operations and scalar functions as small queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions import codes
from memberlens.functions import expr as x
from memberlens.operators import cohort as co
from memberlens.operators import eventlog as ev
from memberlens.operators import notes as nt
from memberlens.operators import tabular as tb
from memberlens.plans import roles as r
from memberlens.plans.registry import query
from memberlens.session import run_folder, shared_dir
from memberlens.sources import tables as src

DEC = "decimal(18,2)"


def money(c):
    return F.sum(F.col(c).cast(DEC)).cast("double")


# ---- A: scans and sinks --------------------------------------------------------------------------------

@query("a1_named_scan", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def a1(t):
    src.session_table(t.lineitem, "named_scan_lineitem")
    return src.scan(t.spark, "named_scan_lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


STATUS_SCRIPT = """
SELECT :source AS source, IDENTIFIER(:status) AS status, COUNT(*) AS n, COUNT(DISTINCT IDENTIFIER(:key)) AS keys
FROM IDENTIFIER(:table) WHERE IDENTIFIER(:amount) >= :least GROUP BY IDENTIFIER(:status)"""


@query("a1_script_over_tables", """
SELECT 'claims' AS source, l_returnflag AS status, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS keys FROM lineitem WHERE l_quantity >= 10 GROUP BY 2
UNION ALL SELECT 'contacts', o_orderstatus, COUNT(*), COUNT(DISTINCT o_custkey) FROM orders WHERE o_totalprice >= 100000 GROUP BY 2""")
def a1_script(t):
    """One stored text over two tables, their columns and thresholds, by session variables."""
    runs = [("claims", t.lineitem, "l_returnflag", "l_suppkey", "l_quantity", 10), ("contacts", t.orders, "o_orderstatus", "o_custkey", "o_totalprice", 100_000)]
    out = []
    for source, df, status, key, amount, least in runs:
        src.session_table(df, f"script_{source}")
        out.append(src.run_script(t.spark, STATUS_SCRIPT, {"table": f"script_{source}", "status": status, "key": key, "amount": amount}, {"source": source, "least": least}))
    return out[0].unionByName(out[1])


@query("a2_scan_with_target", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def a2(t):
    return src.with_target(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query("a3_chunked_scan", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem""")
def a3(t):
    picked = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

    def to_cents(frame):
        cents = (frame["l_extendedprice"] * 100).round().astype("int64")
        return frame.drop(columns="l_extendedprice").assign(cents=cents)

    return src.map_chunks(picked, to_cents, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, cents long")


@query("a4_csv_numeric", """
SELECT s_suppkey, TRY_CAST(s_name AS DOUBLE) AS name_number, s_acctbal FROM supplier""")
def a4(t):
    folder = run_folder(t.spark, "csv")
    src.write_report(t.supplier.select(F.col("s_suppkey").cast("string").alias("s_suppkey"), F.col("s_name").alias("name_number"), "s_acctbal"), folder)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("s_suppkey", "name_number", "s_acctbal")])
    back = src.read_csv_numeric(t.spark, folder, ["name_number", "s_acctbal"], schema)
    return back.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@query("a5_cached_result", """
SELECT o_custkey, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1""")
def a5(t):
    folder = f"{shared_dir(t.spark)}/orders-by-customer-{src.fingerprint(t.orders)}"  # another copy for other files
    return src.cached(t.spark, folder, lambda: t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), money("o_totalprice").alias("spent")))


@query("a6_replace_table", "SELECT event_type, event_id, user_id FROM events")
def a6(t):
    folder = run_folder(t.spark, "table")
    src.replace_table(t.events.select("event_type", "event_id", "user_id"), folder, ["event_type"])
    return t.spark.read.parquet(folder).select("event_type", "event_id", "user_id")


@query("a7_declared_schema_insert", """
SELECT CAST(o_custkey AS VARCHAR) AS member_id, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, COUNT(*)::INTEGER AS n FROM orders GROUP BY 1, 2""")
def a7(t):
    schema = T.StructType([T.StructField("member_id", T.StringType()), T.StructField("month", T.DateType()), T.StructField("n", T.IntegerType())])
    folder = run_folder(t.spark, "declared")
    counted = t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "MONTH").alias("month")).agg(F.count("*").alias("n")).select(
        F.col("n").cast("int").alias("n"), F.col("o_custkey").cast("string").alias("member_id"), "month")
    t.spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
    src.insert_into(counted, schema, folder)
    return t.spark.read.schema(schema).parquet(folder)


@query("a8_session_table", "SELECT n_regionkey, COUNT(*) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def a8(t):
    src.session_table(t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")), "session_members")
    return t.spark.sql("SELECT n_regionkey, count(*) AS members FROM session_members GROUP BY n_regionkey")


@query("a9_inline_dimension", """
SELECT e.event_id, d.weight FROM events e LEFT JOIN (VALUES ('error', 5), ('purchase', 3), ('view', 1)) d(event_type, weight) ON d.event_type = e.event_type""")
def a9(t):
    weights = src.inline(t.spark, [("error", 5), ("purchase", 3), ("view", 1)], "event_type string, weight int")
    return t.events.join(weights, "event_type", "left").select("event_id", "weight")


@query("a10_report_sinks", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def a10(t):
    report = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    folder = run_folder(t.spark, "report")
    src.write_report(report, folder + "-json", "json")
    src.write_report(report, folder + "-csv", "csv")
    as_json = t.spark.read.schema("o_orderstatus string, n long").json(folder + "-json")
    as_csv = t.spark.read.schema("o_orderstatus string, n long").option("header", True).csv(folder + "-csv")
    return as_json.intersect(as_csv)


# ---- B: projections and predicates ---------------------------------------------------------------------

@query("b1_cohort_filter", r.sql(r.MEMBERS, body="""
SELECT member_id, market, UPPER(TRIM(coverage)) AS normalized_coverage,
       CASE WHEN has_ever_been_engaged THEN 'engaged_in_program' WHEN is_batched THEN 'selected_not_engaged' ELSE 'not_selected_for_engagement' END AS engagement_group,
       DATE_DIFF('month', first_selected_date, DATE '2002-01-01')::INTEGER AS months_since_batched
FROM members WHERE is_qualified = 1 AND market IS NOT NULL AND UPPER(TRIM(coverage)) NOT IN ('NULL', 'EXCLUDE')"""))
def b1(t):
    members = r.members(t)
    out = ev.cohort(members.drop("is_qualified"), members.select("member_id", "is_qualified"), F.lit("2002-01-01").cast("date"))
    return out.select("member_id", "market", "normalized_coverage", "engagement_group", "months_since_batched")


@query("b2_value_normalisation", """
SELECT c_custkey, CASE UPPER(TRIM(c_mktsegment)) WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'FURNITURE' THEN 'HOME' ELSE UPPER(TRIM(c_mktsegment)) END AS segment FROM customer""")
def b2(t):
    return t.customer.select("c_custkey", x.normalised_value("c_mktsegment", {"HOUSEHOLD": "HOME", "FURNITURE": "HOME"}).alias("segment"))


@query("b3_priority_status", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'DISENROLLED' WHEN o_orderstatus = 'F' THEN 'ENGAGED' WHEN o_orderstatus = 'O' THEN 'BATCHED'
  WHEN o_orderpriority IS NULL THEN 'UNSERVED GEO' ELSE 'NOT SELECTED' END AS status FROM orders""")
def b3(t):
    view = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("market"),
        F.when(F.col("o_orderpriority").contains("URGENT"), "suspended").otherwise("active").alias("current_status"),
        (F.col("o_orderstatus") == "F").alias("has_ever_been_engaged"), (F.col("o_orderstatus") == "O").alias("is_batched"))
    return view.select("o_orderkey", co.enrolment_status().alias("status"))


@query("b4_condition_flags", r.sql(r.MAPPED, body="SELECT member_id, claim_id, dx_line_number, " + ", ".join(
    f"CASE WHEN hcc_code IN ({', '.join(map(str, v))}) THEN 1 ELSE 0 END AS cnt_hcc_{k}" for k, v in codes.CONDITION_GROUPS.items())
    + ", CASE WHEN hcc_code IS NOT NULL AND hcc_code NOT IN (" + ", ".join(str(c) for g in codes.CONDITION_GROUPS.values() for c in g)
    + ") THEN 1 ELSE 0 END AS cnt_hcc_other_complex FROM mapped"))
def b4(t):
    mapped = ev.mapped_diagnoses(r.diagnoses(t), r.code_map(t))
    return mapped.select("member_id", "claim_id", "dx_line_number", *x.group_flags("hcc_code", codes.CONDITION_GROUPS, "cnt_hcc_", "other_complex"))


@query("b5_one_hot", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS is_seg_machinery, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_seg_building,
       CASE WHEN c_mktsegment IS NULL OR c_mktsegment NOT IN ('MACHINERY', 'BUILDING') THEN 1 ELSE 0 END AS is_seg_other FROM customer""")
def b5(t):
    return t.customer.select("c_custkey", *x.one_hot("c_mktsegment", ["MACHINERY", "BUILDING"], "is_seg_"))


@query("b6_prefix_flags", """
SELECT c_custkey, CASE WHEN LEFT(UPPER(TRIM(c_mktsegment)), 3) = 'AUT' THEN 1 ELSE 0 END AS is_auto,
       CASE WHEN LEFT(UPPER(TRIM(c_mktsegment)), 4) = 'HOUS' THEN 1 ELSE 0 END AS is_house,
       CASE WHEN LEFT(UPPER(TRIM(c_mktsegment)), 3) <> 'AUT' AND LEFT(UPPER(TRIM(c_mktsegment)), 4) <> 'HOUS' THEN 1 ELSE 0 END AS is_other FROM customer""")
def b6(t):
    return t.customer.select("c_custkey", *x.prefix_flags("c_mktsegment", {"is_auto": "AUT", "is_house": "HOUS"}))


@query("b8_bands", "SELECT p_partkey, CAST(FLOOR(p_size / 5) * 5 AS INTEGER) AS size_band, " + ", ".join(
    f"CASE WHEN p_size >= {lo} AND p_size < {lo + 5} THEN 1 ELSE 0 END AS is_size_{lo}_{lo + 4}" for lo in range(5, 40, 5))
    + ", CASE WHEN p_size >= 40 THEN 1 ELSE 0 END AS is_size_40_plus FROM part")
def b8(t):
    return t.part.select("p_partkey", x.band_start("p_size", 5).alias("size_band"), *x.band_flags("p_size", 5, 40, 5, "is_size_"))


@query("b9_encounter_predicates", r.sql(r.CLAIMS, body="""
SELECT claim_id, claim_line_number, paid_amount::DOUBLE AS paid_amount,
       (place_of_service = '23' OR LEFT(COALESCE(revenue_code, ''), 3) = '045') AS is_ed,
       (place_of_service = '21' OR COALESCE(regexp_matches(revenue_code, '^(01[0-9]|02[0-1])'), FALSE)) AS is_ip,
       COALESCE(revenue_code IN ('0450', '0451', '0452', '0456', '0459', '0981'), FALSE) AS is_ed_listed
FROM claims"""))
def b9(t):
    return r.claims(t).select(
        "claim_id", "claim_line_number", F.col("paid_amount").cast("double").alias("paid_amount"),
        x.is_ed_line("place_of_service", "revenue_code").alias("is_ed"), x.is_ip_line("place_of_service", "revenue_code").alias("is_ip"),
        F.coalesce(F.col("revenue_code").isin(codes.ED_REVENUE_CODES), F.lit(False)).alias("is_ed_listed"))


@query("b10_synonym_flag", r.sql(r.FEED, body="""
SELECT event_id, LOWER(setting) IN ('ed', 'emergency') AS is_ed_event, LOWER(setting) IN ('ip', 'inpatient', 'in-patient') AS is_ip_event FROM feed"""))
def b10(t):
    return r.feed(t).select("event_id", x.synonym("setting", codes.ED_SYNONYMS).alias("is_ed_event"), x.synonym("setting", codes.IP_SYNONYMS).alias("is_ip_event"))


@query("b11_first_filled", """
SELECT c_custkey, COALESCE(NULLIF(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), NULLIF(c_name, '')) AS code FROM customer""")
def b11(t):
    return t.customer.select("c_custkey", x.first_filled(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")), "c_name").alias("code"))


@query("b12_date_fallback", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_shipdate IS NULL OR l_shipdate > DATE '2000-01-01' THEN CAST(o_orderdate AS DATE) ELSE CAST(l_shipdate AS DATE) END AS admit_date
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def b12(t):
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         x.date_or_fallback("l_shipdate", "o_orderdate", F.lit("2000-01-01").cast("date")).alias("admit_date"))


@query("b13_threshold_flags", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS is_big, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS is_cheap FROM lineitem")
def b13(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", x.at_least("l_quantity", 40).alias("is_big"), x.at_least("l_discount", 0.05).alias("is_cheap"))


THREE = """
WITH m AS (SELECT c_custkey, MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS top, MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS present
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN top >= 400000 THEN 1 WHEN present = 1 THEN 0 END AS urgent_high, CASE WHEN present = 1 THEN top END AS urgent_top FROM m"""


def _urgent(t):
    joined = t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return joined.groupBy("c_custkey").agg(F.max(F.when(urgent, F.col("o_totalprice"))).alias("top"), F.max(x.flag(urgent)).alias("present"))


@query("b14_three_state", THREE.replace(", CASE WHEN present = 1 THEN top END AS urgent_top", ""))
def b14(t):
    return _urgent(t).select("c_custkey", x.three_state(F.col("top") >= 400000, F.col("present") == 1).alias("urgent_high"))


@query("b15_gated_value", THREE.replace("CASE WHEN top >= 400000 THEN 1 WHEN present = 1 THEN 0 END AS urgent_high, ", ""))
def b15(t):
    return _urgent(t).select("c_custkey", x.gated(F.col("present") == 1, "top").alias("urgent_top"))


@query("b16_imputation", """
WITH v AS (SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(COALESCE(quality, 1.5) AS DOUBLE) AS constant_fill, COALESCE(quality, 0) AS zero_fill, ROUND(COALESCE(quality, (SELECT AVG(quality) FROM v)), 6) AS mean_fill FROM v""")
def b16(t):
    v = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    mean = v.agg(F.avg("quality").alias("m"))
    return v.select("doc_id", F.coalesce(F.col("quality"), F.lit(1.5)).alias("constant_fill"), F.coalesce(F.col("quality"), F.lit(0)).alias("zero_fill"),
                    F.round(F.coalesce(F.col("quality").cast("double"), mean.scalar()), 6).alias("mean_fill"))


@query("b17_numeric_features", "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def b17(t):
    kept, _ = x.numeric_features(t.lineitem, exclude=["L_ORDERKEY"], exclude_prefixes=["l_part"], exclude_suffixes=["suppkey"])
    return t.lineitem.groupBy(*kept).agg(F.count("*").alias("n"))


@query("b18_align_columns", "SELECT c_custkey, c_acctbal, 0 AS c_missing FROM customer")
def b18(t):
    return x.aligned(t.customer, ["c_custkey", "c_acctbal", "c_missing"])


@query("b19_cast_doubles", "SELECT l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_suppkey::DOUBLE AS l_suppkey FROM lineitem")
def b19(t):
    upper = t.lineitem.select(*[F.col(c).alias(c.upper()) for c in ("l_orderkey", "l_linenumber", "l_suppkey")])
    return x.as_doubles(upper, ["L_LINENUMBER", "l_suppkey"])


@query("b20_either_label", "SELECT d.doc_id, GREATEST(COALESCE(quality, 0), COALESCE(toxic, 0)) AS any_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def b20(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", x.either("quality", "toxic").alias("any_label"))


# ---- C: joins ------------------------------------------------------------------------------------------

COHORT_SQL = r.MEMBERS + ", cohort AS (SELECT member_id FROM members WHERE is_qualified = 1)"


def cohort(t):
    return t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("member_id"))


@query("c1_inner_join", r.sql(COHORT_SQL, r.CLAIMS, body="SELECT member_id, claim_id, claim_line_number, provider_id FROM claims JOIN cohort USING (member_id)"))
def c1(t):
    return r.claims(t).join(cohort(t), "member_id").select("member_id", "claim_id", "claim_line_number", "provider_id")


@query("c2_left_join_composite", r.sql(r.FEED, body="""
, a AS (SELECT DISTINCT member_id, admit_date FROM feed), b AS (SELECT member_id, admit_date, COUNT(*) AS n_error FROM feed WHERE event_type = 'error' GROUP BY 1, 2)
SELECT a.member_id, a.admit_date, b.n_error FROM a LEFT JOIN b ON b.member_id = a.member_id AND b.admit_date = a.admit_date"""))
def c2(t):
    feed = r.feed(t)
    errors = feed.where("event_type = 'error'").groupBy("member_id", "admit_date").agg(F.count("*").alias("n_error"))
    return feed.select("member_id", "admit_date").distinct().join(errors, ["member_id", "admit_date"], "left")


@query("c4_full_outer_join", r.sql(r.FEED, body="""
, a AS (SELECT member_id, admit_date, COUNT(*) AS n_error FROM feed WHERE event_type = 'error' GROUP BY 1, 2),
b AS (SELECT member_id, admit_date, COUNT(*) AS n_purchase FROM feed WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT COALESCE(a.member_id, b.member_id) AS member_id, COALESCE(a.admit_date, b.admit_date) AS admit_date, COALESCE(n_error, 0) AS n_error, COALESCE(n_purchase, 0) AS n_purchase
FROM a FULL OUTER JOIN b ON a.member_id = b.member_id AND a.admit_date = b.admit_date"""))
def c4(t):
    feed, keys = r.feed(t), ["member_id", "admit_date"]
    side = {k: feed.where(F.col("event_type") == k).groupBy(*keys).agg(F.count("*").alias(f"n_{k}")) for k in ("error", "purchase")}
    return tb.full_outer(side["error"], side["purchase"], keys)


@query("c5_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def c5(t):
    users = t.events.select(F.col("user_id").alias("o_custkey"))
    return t.orders.join(users, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("c6_exists_flag", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND e.event_type = 'error') THEN 1 ELSE 0 END AS had_error FROM customer")
def c6(t):
    errors = t.events.where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return tb.exists_flag(t.customer.select("c_custkey"), errors, ["c_custkey"], "had_error")


@query("c7_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def c7(t):
    users = t.events.select(F.col("user_id").alias("c_custkey"))
    return tb.without(t.customer.select("c_custkey"), users, "c_custkey")


@query("c8_category_scaffold", "SELECT DISTINCT user_id, c.name AS category FROM events CROSS JOIN (VALUES " + ", ".join(f"('{c}')" for c in codes.NOTE_CATEGORIES) + ") c(name)")
def c8(t):
    return tb.scaffold(t.events.select("user_id").distinct(), codes.NOTE_CATEGORIES)


@query("c14_normalised_code_join", r.sql(r.MAPPED, body="SELECT member_id, claim_id, dx_line_number, icd_code, hcc_code FROM mapped"))
def c14(t):
    current = (F.col("model_version") == codes.CODE_MAP_VERSION) & (F.col("payment_year") == codes.CODE_MAP_YEAR)
    return tb.code_join(r.diagnoses(t), "icd_code", r.code_map(t), "diagnosis_code", ["hcc_code"], current).select(
        "member_id", "claim_id", "dx_line_number", "icd_code", "hcc_code")


ENCOUNTERS = r.FEED + """,
feeds AS (
  SELECT DISTINCT member_id, admit_date, CASE event_type WHEN 'error' THEN 'zus' WHEN 'purchase' THEN 'auth' ELSE 'check' END AS source_type
  FROM feed WHERE event_type IN ('error', 'purchase', 'signup')),
reconciled AS (
  SELECT d.member_id, d.admit_date, CAST(DATE_TRUNC('month', d.admit_date) AS DATE) AS month,
         CASE WHEN a.member_id IS NULL THEN 0 ELSE 1 END AS zus_validated, CASE WHEN b.member_id IS NULL THEN 0 ELSE 1 END AS auth_validated,
         CASE WHEN c.member_id IS NULL THEN 0 ELSE 1 END AS hc_validated
  FROM (SELECT DISTINCT member_id, admit_date FROM feeds) d
  LEFT JOIN feeds a ON a.member_id = d.member_id AND a.admit_date = d.admit_date AND a.source_type = 'zus'
  LEFT JOIN feeds b ON b.member_id = d.member_id AND b.admit_date = d.admit_date AND b.source_type = 'auth'
  LEFT JOIN feeds c ON c.member_id = d.member_id AND c.admit_date = d.admit_date AND c.source_type = 'check')"""


def encounters(t):
    kinds = F.expr("CASE event_type WHEN 'error' THEN 'zus' WHEN 'purchase' THEN 'auth' WHEN 'signup' THEN 'check' END")
    feeds = r.feed(t).withColumn("source_type", kinds).where("source_type IS NOT NULL")
    return co.reconcile_encounters(feeds, {"zus_validated": "zus", "auth_validated": "auth", "hc_validated": "check"})


@query("c16_multi_source_match", r.sql(ENCOUNTERS, body="SELECT * FROM reconciled"))
def c16(t):
    return encounters(t)


@query("k48_encounter_reconciliation", r.sql(ENCOUNTERS, body="""
SELECT member_id, month, COUNT(DISTINCT admit_date) AS num_admissions, CAST(SUM(zus_validated) AS BIGINT) AS count_zus_validated,
       CAST(SUM(auth_validated) AS BIGINT) AS count_auth_validated, CAST(SUM(hc_validated) AS BIGINT) AS count_hc_validated
FROM reconciled GROUP BY 1, 2"""))
def k48(t):
    return co.encounter_months(encounters(t), ["zus_validated", "auth_validated", "hc_validated"])


@query("c17_join_miss_reasons", """
WITH m AS (SELECT c_custkey AS member_id, c_mktsegment AS coverage FROM customer WHERE c_acctbal < 8000), q AS (SELECT c_custkey AS member_id, CASE WHEN c_acctbal > 1000 THEN 1 ELSE 0 END AS q FROM customer WHERE c_acctbal > 0),
lost AS (SELECT DISTINCT o_custkey AS member_id FROM orders)
SELECT CASE WHEN m.member_id IS NULL THEN 'not in member list' WHEN q.q = 0 THEN 'not qualified' WHEN q.q IS NULL THEN 'no qualification entry'
            WHEN UPPER(TRIM(coverage)) IN ('BUILDING') THEN 'excluded coverage' ELSE 'other' END AS failure_reason, COUNT(DISTINCT lost.member_id) AS unmatched_members
FROM lost LEFT JOIN m ON m.member_id = lost.member_id LEFT JOIN q ON q.member_id = lost.member_id GROUP BY 1""")
def c17(t):
    events = t.orders.select(F.col("o_custkey").alias("member_id"), F.lit(None).cast("string").alias("market"))
    members = t.customer.where("c_acctbal < 8000").select(F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("coverage"))
    qualified = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("member_id"), x.flag(F.col("c_acctbal") > 1000).alias("is_qualified"))
    return co.unmatched_reasons(events, members, qualified, ["BUILDING"])


# ---- D: aggregates -------------------------------------------------------------------------------------

@query("d1_group_by", """
SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price,
       ROUND(CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 9) AS avg_discount, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def d1(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"),
        F.round(money("l_discount") / F.count("*"), 9).alias("avg_discount"), F.count("*").alias("n"))


@query("d2_any_flag", "SELECT l_suppkey, MAX(CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 1 ELSE 0 END) AS any_big_return FROM lineitem GROUP BY 1")
def d2(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max(x.flag((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))).alias("any_big_return"))


@query("d3_conditional_sum_count", """
SELECT l_suppkey, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS returned, COUNT(CASE WHEN l_linestatus = 'O' THEN 1 END) AS n_open FROM lineitem GROUP BY 1""")
def d3(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice").cast(DEC)).otherwise(0)).cast("double").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"))


@query("d4_conditional_distinct", r.sql(r.CLAIMS, body="""
SELECT member_id, COUNT(DISTINCT CASE WHEN place_of_service = '23' THEN service_date END) AS ed_days, COUNT(DISTINCT CASE WHEN place_of_service = '21' THEN provider_id END) AS ip_providers FROM claims GROUP BY 1"""))
def d4(t):
    claims, place = r.claims(t), F.col("place_of_service")
    return tb.conditional_distinct(claims, ["member_id"], {
        "ed_days": (place == "23", F.col("service_date")), "ip_providers": (place == "21", F.col("provider_id"))})


@query("d6_first_date", """
SELECT o_custkey, MIN(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS first_f, MIN(CASE WHEN o_totalprice > 400000 THEN CAST(o_orderdate AS DATE) END) AS first_big FROM orders GROUP BY 1""")
def d6(t):
    d = F.to_date("o_orderdate")
    return t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", d)).alias("first_f"), F.min(F.when(F.col("o_totalprice") > 400000, d)).alias("first_big"))


@query("d7_ratio_aggregate", """
SELECT o_custkey, CAST(COUNT(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / NULLIF(COUNT(*) FILTER (o_orderstatus IN ('F', 'O')), 0) AS success_rate FROM orders GROUP BY 1""")
def d7(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(x.ratio(F.count_if(s == "F"), F.count_if(s.isin("F", "O"))).alias("success_rate"))


@query("d8_dedupe_then_sum", r.sql(r.FILLS, body="SELECT member_id, CAST(SUM(days_supply) AS BIGINT) AS days FROM (SELECT DISTINCT member_id, ndc, filled_date, days_supply FROM fills) GROUP BY 1"))
def d8(t):
    return r.fills(t).select("member_id", "ndc", "filled_date", "days_supply").distinct().groupBy("member_id").agg(F.sum("days_supply").alias("days"))


@query("d9_ordered_text", "SELECT conv_id, STRING_AGG(COALESCE(role, ''), ' ' ORDER BY role) AS roles, COUNT(*) AS n FROM conversations GROUP BY 1")
def d9(t):
    return tb.ordered_text(t.conversations, ["conv_id"], "role", "roles", count="n")


@query("d10_distinct_array", "SELECT l_orderkey, ARRAY_TO_STRING(LIST_SORT(ARRAY_AGG(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY 1")
def d10(t):
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return pairs.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("suppliers"))


@query("d11_map_aggregate", """
WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, '{' || STRING_AGG('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts FROM c GROUP BY 1""")
def d11(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return tb.as_map(counts, ["user_id"], "event_type", "n", "counts").select("user_id", F.to_json("counts").alias("counts"))


@query("d12_duplicate_rows", "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem")
def d12(t):
    return tb.repeated_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d13_approximate_distinct", r.sql(r.CLAIMS, body="""
, months AS (SELECT YEAR(service_date)::VARCHAR AS period, member_id, place_of_service FROM claims UNION ALL SELECT 'all', member_id, place_of_service FROM claims)
SELECT period, COUNT(DISTINCT member_id) AS members, TRUE AS members_near, COUNT(DISTINCT CASE WHEN place_of_service = '23' THEN member_id END) AS members_ed, TRUE AS members_ed_near
FROM months GROUP BY 1"""))
def d13(t):
    """Sketches stored per month answer for years and for all time; each estimate is held against the exact count."""
    claims = r.claims(t).select("member_id", "service_date", F.when(F.col("place_of_service") == "23", F.col("member_id")).alias("ed_member"))
    names = ["members", "members_ed"]
    by_month = src.stored(tb.distinct_sketches(claims, [F.trunc("service_date", "MONTH").alias("month")], {"members": F.col("member_id"), "members_ed": F.col("ed_member")}), "monthly-sketches")
    dated = by_month.withColumn("period", F.explode(F.array(F.year("month").cast("string"), F.lit("all"))))
    near = tb.estimates(tb.merged_sketches(dated, ["period"], names), names)
    periods = claims.withColumn("period", F.explode(F.array(F.year("service_date").cast("string"), F.lit("all"))))
    exact = tb.conditional_distinct(periods, ["period"], {"exact": (F.lit(True), F.col("member_id")), "exact_ed": (F.lit(True), F.col("ed_member"))})
    return near.join(exact, "period").select(
        "period", F.col("exact").alias("members"), tb.within_error(F.col("members"), F.col("exact")).alias("members_near"),
        F.col("exact_ed").alias("members_ed"), tb.within_error(F.col("members_ed"), F.col("exact_ed")).alias("members_ed_near"))


@query("d14_sample_deviation", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd_qty, ROUND(STDDEV_SAMP(l_discount), 6) AS sd_discount FROM lineitem GROUP BY 1")
def d14(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"), F.round(F.stddev_samp("l_discount"), 6).alias("sd_discount"))


@query("d15_having_count", "SELECT l_orderkey, l_linenumber, COUNT(*) AS record_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def d15(t):
    return tb.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d16_two_level", """
SELECT ROUND(AVG(a), 4) AS avg_member_o_totalprice, ROUND(AVG(b), 4) AS avg_member_o_orderkey FROM (SELECT o_custkey, MAX(o_totalprice) AS a, MAX(o_orderkey) AS b FROM orders GROUP BY 1)""")
def d16(t):
    out = tb.mean_of_member_max(t.orders, ["o_totalprice", "o_orderkey"], "o_custkey")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("d17_share_of_total", "SELECT o_orderpriority, COUNT(*) AS row_count, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM orders) AS share FROM orders GROUP BY 1")
def d17(t):
    return tb.share_of_total(t.orders, ["o_orderpriority"])


@query("d19_rates_per_thousand", """
WITH c AS (SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f, COUNT(DISTINCT CASE WHEN o_totalprice > 450000 THEN o_custkey END) AS b FROM orders)
SELECT 'finished' AS label, ROUND(f * 1000.0 / n, 6)::DOUBLE AS rate_per_1000_members FROM c UNION ALL SELECT 'big', ROUND(b * 1000.0 / n, 6)::DOUBLE FROM c""")
def d19(t):
    out = tb.rates_per_thousand(t.orders, {"finished": F.col("o_orderstatus") == "F", "big": F.col("o_totalprice") > 450000}, "o_custkey")
    return out.withColumn("rate_per_1000_members", F.round("rate_per_1000_members", 6))


@query("d20_yearly_summary", r.sql(r.CLAIMS, body="""
SELECT YEAR(service_date)::INTEGER AS year, COUNT(DISTINCT member_id) AS members, COUNT(DISTINCT claim_id) AS claims, COUNT(*) AS lines,
       COUNT(DISTINCT claim_id)::DOUBLE / COUNT(DISTINCT member_id) AS claims_per_member, COUNT(*)::DOUBLE / COUNT(DISTINCT member_id) AS lines_per_member,
       ROUND(CAST(SUM(paid_amount) AS DOUBLE) / COUNT(DISTINCT member_id), 6) AS mean_member_total FROM claims GROUP BY 1"""))
def d20(t):
    return tb.yearly_summary(r.claims(t)).withColumn("mean_member_total", F.round("mean_member_total", 6))


# ---- F: order and top-k --------------------------------------------------------------------------------

@query("f1_order_by", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders ORDER BY o_custkey DESC, d DESC, o_orderkey")
def f1(t):
    return t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey").orderBy(F.desc("o_custkey"), F.desc("d"), "o_orderkey")


VISITS = r.MAPPED + """,
v AS (
  SELECT hcc_code, icd_code, icd_desc,
         place_of_service = '23' OR COALESCE(revenue_code IN ('0450', '0451', '0452', '0456', '0459', '0981'), FALSE) AS ed,
         place_of_service = '21' OR COALESCE(revenue_code IN (
           '0100', '0101', '0110', '0111', '0112', '0113', '0114', '0120', '0121', '0122', '0123', '0124', '0130', '0131', '0132', '0133',
           '0134', '0140', '0141', '0142', '0143', '0144', '0150', '0151', '0152', '0153', '0154', '0160', '0164', '0170', '0171', '0172',
           '0173', '0174', '0179', '0200', '0201', '0202', '0203', '0204', '0206', '0207', '0208', '0209', '0210', '0211', '0212', '0214',
           '0219'), FALSE) AS ip
  FROM mapped WHERE hcc_code IS NOT NULL AND (ed OR ip)),
r1 AS (SELECT hcc_code, kind, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY COUNT(*) DESC, hcc_code) AS rn
       FROM (SELECT hcc_code, 'ED' AS kind FROM v WHERE ed UNION ALL SELECT hcc_code, 'IP' FROM v WHERE ip) GROUP BY 1, 2),
r2 AS (SELECT hcc_code, icd_code, icd_desc, COUNT(*) AS icd_count, ROW_NUMBER() OVER (PARTITION BY hcc_code ORDER BY COUNT(*) DESC, icd_code, icd_desc) AS rn
       FROM v WHERE hcc_code IN (SELECT hcc_code FROM r1 WHERE rn <= 5) GROUP BY 1, 2, 3)"""


def top_conditions(t):
    mapped = ev.mapped_diagnoses(r.diagnoses(t), r.code_map(t))
    listed = lambda revenue: F.coalesce(F.col("revenue_code").isin(revenue), F.lit(False))
    visits = {
        "ED": (F.col("place_of_service") == codes.ED_PLACE) | listed(codes.ED_REVENUE_CODES),
        "IP": (F.col("place_of_service") == codes.IP_PLACE) | listed(codes.IP_REVENUE_CODES),
    }
    return tb.top_codes(mapped, visits, 5)


@query("f2_two_stage_top_k", r.sql(VISITS, body="SELECT hcc_code, icd_code, icd_desc, icd_count FROM r2 WHERE rn <= 5"))
def f2(t):
    return top_conditions(t).drop("rn")


@query("k49_top_conditions", r.sql(VISITS, body="SELECT hcc_code, icd_code, icd_desc, icd_count, rn::INTEGER AS rn FROM r2 WHERE rn <= 5"))
def k49(t):
    return top_conditions(t)


@query("k49_search_by_description", r.sql(r.MAPPED, body="SELECT DISTINCT hcc_code FROM mapped WHERE UPPER(icd_desc) LIKE '%WIDGET%' AND hcc_code IS NOT NULL"))
def k49_search(t):
    return tb.categories_by_description(ev.mapped_diagnoses(r.diagnoses(t), r.code_map(t)), "widget")


@query("f3_top_individuals", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f3(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("f4_limit_sample", "SELECT c_custkey FROM customer ORDER BY MD5(c_custkey::VARCHAR), c_custkey LIMIT 10")
def f4(t):
    return t.customer.select("c_custkey").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(10)


@query("f5_latest_periods", """
SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month FROM orders
WHERE DATE_TRUNC('month', o_orderdate) IN (SELECT DISTINCT DATE_TRUNC('month', o_orderdate) AS m FROM orders ORDER BY m DESC LIMIT 3)""")
def f5(t):
    return tb.latest_periods(t.orders.select("o_orderkey", F.trunc("o_orderdate", "MONTH").alias("month")), "month", 3).select("o_orderkey", "month")


# ---- G: set operations ---------------------------------------------------------------------------------

def unlike(t):
    return {
        "order": t.orders.select(F.col("o_custkey").alias("member_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_totalprice").alias("amount")),
        "event": t.events.select(F.col("user_id").alias("member_id"), F.to_date("ts").alias("event_date"), "event_type"),
    }


@query("g1_union_unlike", """
SELECT 'order' AS origin, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS event_date, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS event_type FROM orders
UNION ALL SELECT 'event', user_id, CAST(ts AS DATE), NULL, event_type FROM events""")
def g1(t):
    return ev.union_feeds(unlike(t))


@query("g2_union_distinct", "SELECT o_custkey AS member_id FROM orders UNION SELECT user_id FROM events")
def g2(t):
    return t.orders.select(F.col("o_custkey").alias("member_id")).union(t.events.select("user_id")).distinct()


@query("g3_distinct", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS event_date FROM events")
def g3(t):
    return t.events.select("user_id", F.to_date("ts").alias("event_date")).distinct()


@query("g4_stack_with_origin", "SELECT l.l_orderkey AS k, 'line' AS split FROM lineitem l UNION ALL SELECT o_orderkey, 'order' FROM orders")
def g4(t):
    return src.stacked({"line": t.lineitem.select(F.col("l_orderkey").alias("k")), "order": t.orders.select(F.col("o_orderkey").alias("k"))}, "split")


# ---- H: scalar functions -------------------------------------------------------------------------------

@query("h1_string_cleanup", """
SELECT p_partkey, UPPER(TRIM(p_name)) AS a, LOWER(p_type) AS b, LEFT(p_brand, 5) AS c, REPLACE(p_brand, '#', '') AS d, LENGTH(p_name)::INTEGER AS e, SUBSTRING(p_name, 2, 3) AS f FROM part""")
def h1(t):
    return t.part.select("p_partkey", x.clean("p_name").alias("a"), F.lower("p_type").alias("b"), x.prefix("p_brand", 5).alias("c"),
                         F.replace("p_brand", F.lit("#"), F.lit("")).alias("d"), F.length("p_name").alias("e"), F.substring("p_name", 2, 3).alias("f"))


@query("h2_like", "SELECT p_partkey, p_brand LIKE 'Brand_2%' AS a, UPPER(p_name) LIKE '%RING%' AS b FROM part")
def h2(t):
    return t.part.select("p_partkey", F.col("p_brand").like("Brand_2%").alias("a"), F.upper("p_name").contains("RING").alias("b"))


@query("h3_regex_dotall", """
SELECT doc_id, NULLIF(regexp_extract(text, '(e.*e)', 1, 's'), '') AS span_text, regexp_matches(text, '^[A-Z]') AS starts_upper FROM documents""")
def h3(t):
    return t.documents.select("doc_id", F.nullif(F.regexp_extract("text", "(?s)(e.*e)", 1), F.lit("")).alias("span_text"), F.col("text").rlike("^[A-Z]").alias("starts_upper"))


@query("h4_key_building", "SELECT o_orderkey, o_custkey || '|' || COALESCE(CAST(NULLIF(o_orderpriority, '5-LOW') AS VARCHAR), ' ') AS k, 'p:' || NULLIF(o_orderpriority, '5-LOW') AS with_null FROM orders")
def h4(t):
    maybe = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return t.orders.select("o_orderkey", F.concat_ws("|", F.col("o_custkey").cast("string"), F.coalesce(maybe, F.lit(" "))).alias("k"),
                           F.concat(F.lit("p:"), maybe).alias("with_null"))


@query("h5_template_fill", "SELECT conv_id, turn, REPLACE(REPLACE('On {{DATE}} said: {{NOTES}}', '{{DATE}}', role), '{{NOTES}}', text) AS prompt FROM conversations")
def h5(t):
    return t.conversations.select("conv_id", "turn", x.fill_template(F.lit("On {{DATE}} said: {{NOTES}}"), {"DATE": F.col("role"), "NOTES": F.col("text")}).alias("prompt"))


@query("h6_truncate_flag", "SELECT doc_id, SUBSTRING(text, 1, 6000) AS short_text, LENGTH(text) > 6000 AS is_oversized FROM documents")
def h6(t):
    short, over = x.truncated("text", 6000)
    return t.documents.select("doc_id", short.alias("short_text"), over.alias("is_oversized"))


@query("h7_date_parts", """
SELECT o_orderkey, YEAR(d)::INTEGER AS y, MONTH(d)::INTEGER AS m, DAYOFWEEK(d)::INTEGER AS dow, CAST(DATE_TRUNC('month', d) AS DATE) AS month_start, MAKE_DATE(YEAR(d), MONTH(d), 1) AS built
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def h7(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), x.weekday_from_sunday(d).alias("dow"), x.month_start(d).alias("month_start"),
                           F.make_date(F.year(d), F.month(d), F.lit(1)).alias("built"))


@query("h8_date_arithmetic", """
SELECT o_orderkey, d + 90 AS plus_days, CAST(d + INTERVAL 4 MONTH AS DATE) AS plus_months, DATE_DIFF('day', d, DATE '2002-01-01')::INTEGER AS days,
       DATE_DIFF('month', d, DATE '2002-01-01')::INTEGER AS months, DATE_DIFF('year', d, DATE '2002-01-01')::INTEGER AS years
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def h8(t):
    d, asof = F.to_date("o_orderdate"), F.lit("2002-01-01").cast("date")
    return t.orders.select("o_orderkey", F.date_add(d, 90).alias("plus_days"), F.add_months(d, 4).alias("plus_months"), F.datediff(asof, d).alias("days"),
                           x.months_crossed(d, asof).alias("months"), x.years_crossed(d, asof).alias("years"))


@query("h9_numeric", """
SELECT c_custkey, GREATEST(COALESCE(c_acctbal, 0), 100.0)::DOUBLE AS g, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, ROUND(c_nationkey / 90.0::DOUBLE, 9) AS q,
       ROUND(DATE_DIFF('day', DATE '1970-01-01' + CAST(FLOOR(c_acctbal) AS INTEGER), DATE '1990-01-01') / 365.25::DOUBLE, 6) AS age
FROM customer""")
def h9(t):
    birth = F.date_add(F.lit("1970-01-01").cast("date"), F.floor("c_acctbal").cast("int"))
    age = F.coalesce(x.age_in_years(birth, F.lit("1990-01-01").cast("date")), F.datediff(F.lit("1990-01-01").cast("date"), birth) / F.lit(365.25))
    return t.customer.select("c_custkey", F.greatest(F.coalesce("c_acctbal", F.lit(0.0)), F.lit(100.0)).alias("g"), F.floor("c_acctbal").alias("f"),
                             F.round(F.col("c_nationkey") / F.lit(90.0), 9).alias("q"), F.round(age, 6).alias("age"))


@query("h10_safe_casts", "SELECT p_partkey, TRY_CAST(SUBSTRING(p_brand, 7) AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS name_no, TRY_CAST(p_brand AS DATE) AS d, p_size::VARCHAR AS s FROM part")
def h10(t):
    return t.part.select("p_partkey", F.substring("p_brand", 7, 10).try_cast("int").alias("brand_no"), F.col("p_name").try_cast("int").alias("name_no"),
                         F.col("p_brand").try_cast("date").alias("d"), F.col("p_size").cast("string").alias("s"))


@query("h11_array_except", """
SELECT user_id, CASE WHEN LEN(LIST_FILTER(a, lambda v: NOT LIST_CONTAINS(b, v))) > 0 THEN 1 ELSE 0 END AS has_new FROM (
  SELECT user_id, COALESCE(ARRAY_AGG(DISTINCT event_type) FILTER (CAST(ts AS DATE) >= DATE '2024-01-25'), []) AS a, COALESCE(ARRAY_AGG(DISTINCT event_type) FILTER (CAST(ts AS DATE) < DATE '2024-01-25'), []) AS b
  FROM events GROUP BY 1)""")
def h11(t):
    late = F.to_date("ts") >= F.lit("2024-01-25").cast("date")
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(late, F.col("event_type"))).alias("a"), F.collect_set(F.when(~late, F.col("event_type"))).alias("b"))
    return sets.select("user_id", x.flag(F.size(F.array_except("a", "b")) > 0).alias("has_new"))


@query("h12_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def h12(t):
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("h12_variant_replies", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 'ITEMS' AS kind, 2 AS depth, 'Health' AS category, (k % 5)::DOUBLE AS score, 'BIGINT' AS value_type FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'ITEMS', 2, 'Self', NULL, 'STRING' FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'ITEMS', 0, 'Risk', CASE WHEN k % 2 = 0 THEN k + 0.5 END::DOUBLE, CASE WHEN k % 2 = 0 THEN 'DECIMAL(' || CASE WHEN k = 0 THEN 1 ELSE LENGTH(k::VARCHAR) + 1 END || ',1)' ELSE 'MISSING' END FROM e WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'ITEMS', 3, 'Trust', k::DOUBLE, 'STRING' FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 'ITEMS', 3, 'Care', NULL, 'BOOLEAN' FROM e WHERE event_type = 'click' AND k % 2 = 0
UNION ALL SELECT event_id, CASE k % 3 WHEN 0 THEN 'NOT_JSON' WHEN 1 THEN 'EMPTY' ELSE 'NO_ITEMS' END, NULL, NULL, NULL, NULL FROM e WHERE event_type NOT IN ('view', 'purchase', 'click')""")
def h12_variants(t):
    """Replies of five shapes with scores of mixed types, read without knowing which shape comes."""
    k = F.get_json_object("props", "$.k").cast("int")
    text, kind = k.cast("string"), F.col("event_type")

    def filled(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    reply = (
        F.when(kind == "view", filled('{"scores":[{"category":"Health","score":', (k % 5).cast("string"), '},{"category":"Self","score":"many"},7]}'))
        .when(kind == "purchase", F.when(k % 2 == 0, filled('{"category":"Risk","score":', text, ".5}")).otherwise(F.lit('{"category":"Risk"}')))
        .when(kind == "click", filled('{"by":{"group":{"a":{"category":"Trust","score":"', text, '"}', F.when(k % 2 == 0, ',"b":{"category":"Care","score":true}').otherwise(""), '}}}'))
        .when(k % 3 == 0, '{"scores": [oops').when(k % 3 == 1, "  ").otherwise('{"note":"none"}'))
    return nt.variant_items(t.events.select("event_id", reply.alias("raw_response")), keep=["event_id"])


@query("h13_json_build", "SELECT c_custkey, '{\"key\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS js FROM customer")
def h13(t):
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))).alias("js"))


@query("h14_null_handling", "SELECT d.doc_id, COALESCE(quality, -1) AS a, NULLIF(quality, 0) AS b, toxic IS NULL AS c, CASE WHEN quality = 1 THEN 'y' ELSE 'n' END AS e FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def h14(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("a"), F.nullif(F.col("quality"), F.lit(0)).alias("b"), F.col("toxic").isNull().alias("c"),
        F.when(F.col("quality") == 1, "y").otherwise("n").alias("e"))


# ---- K: cohort splits, extraction, areas ---------------------------------------------------------------

BUCKET = "CAST('0x' || SUBSTR(MD5(o_custkey::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 * 100"


@query("k37_dataset_variants", """
SELECT 'all' AS variant, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS members FROM orders UNION ALL SELECT 'engaged', COUNT(*), COUNT(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'pre_period', COUNT(*), COUNT(DISTINCT o_custkey) FROM orders WHERE o_orderdate < DATE '1998-01-01'""")
def k37(t):
    variants = co.dataset_variants(t.orders, {"all": F.lit(True), "engaged": F.col("o_orderstatus") == "F", "pre_period": F.col("o_orderdate") < F.lit("1998-01-01").cast("date")})
    return co.control_counts(variants, "o_custkey").select(F.col("table_name").alias("variant"), F.col("row_count").alias("n"), F.col("unique_members").alias("members"))


@query("k38_split_80_20", f"SELECT o_orderkey, o_custkey, CASE WHEN {BUCKET} < 80 THEN 'TRAIN' ELSE 'TEST' END AS dataset_split FROM orders")
def k38(t):
    return co.member_split(t.orders, {"TRAIN": 0.8, "TEST": 0.2}, "o_custkey", column="dataset_split").select("o_orderkey", "o_custkey", "dataset_split")


@query("k39_split_60_20_20", f"""
SELECT o_orderkey, o_custkey, CASE WHEN {BUCKET} < 60 THEN 'train' WHEN {BUCKET} < 80 THEN 'val' ELSE 'test' END AS split FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NOT NULL""")
def k39(t):
    with_target = t.orders.withColumn("target", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return co.labelled_split(with_target, "target", key="o_custkey").select("o_orderkey", "o_custkey", "split")


@query("k40_area_outliers", """
WITH a AS (SELECT n_nationkey, n_name, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS income, COUNT(*) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT n_name, CASE WHEN income < (SELECT AVG(income) - STDDEV_SAMP(income) FROM a) THEN 1 ELSE 0 END AS income_outlier,
       CASE WHEN members > (SELECT AVG(members) + STDDEV_SAMP(members) FROM a) THEN 1 ELSE 0 END AS members_outlier FROM a""")
def k40(t):
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    areas = joined.groupBy("n_nationkey", "n_name").agg((money("c_acctbal") / F.count("*")).alias("income"), F.count("*").alias("members"))
    return tb.outlier_flags(areas, {"income": "low", "members": "high"}, "n_name")


# Fixed for the comparison: descriptions of the area columns, as a metadata file would give them.
AREA_LABELS = [("c1", "Estimate: median household income"), ("c2", "Estimate: persons below poverty level"), ("c3", "Estimate: total households"),
               ("c4", "Estimate: median age"), ("c9", "Estimate: income of a column that is not there")]


@query("k40_keyword_outliers", """
WITH a AS (
  SELECT n_name, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS c1, COUNT(*) FILTER (c_acctbal < 0) AS c2 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT n_name, CASE WHEN c1 < (SELECT AVG(c1) - STDDEV_SAMP(c1) FROM a) THEN 1 ELSE 0 END AS c1_outlier, CASE WHEN c2 > (SELECT AVG(c2) + STDDEV_SAMP(c2) FROM a) THEN 1 ELSE 0 END AS c2_outlier FROM a""")
def k40_keywords(t):
    """Outlier columns and their bad sides chosen by keywords in the metadata."""
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    areas = joined.groupBy("n_name").agg(
        (money("c_acctbal") / F.count("*")).alias("c1"), F.count_if(F.col("c_acctbal") < 0).alias("c2"), F.count("*").alias("c3"), F.avg("c_custkey").alias("c4"))
    metadata = src.inline(t.spark, AREA_LABELS, "column_code string, label string")
    return tb.outlier_flags(areas, tb.keyword_directions(metadata, {"income": "low", "poverty": "high", "education": "low"}, areas.columns), "n_name")


@query("k46_cohort_extraction", r.sql(COHORT_SQL, r.CLAIMS, r.CONTACTS, body="""
SELECT 'claims' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT member_id) AS unique_members FROM claims WHERE member_id IN (SELECT member_id FROM cohort)
UNION ALL SELECT 'contacts', COUNT(*), COUNT(DISTINCT member_id) FROM contacts WHERE member_id IN (SELECT member_id FROM cohort) AND contact_subject = 'individual'
UNION ALL SELECT 'feed', COUNT(*), COUNT(DISTINCT user_id) FROM events WHERE user_id IN (SELECT member_id FROM cohort)"""))
def k46(t):
    members = cohort(t)
    return co.control_counts({
        "claims": co.restricted(r.claims(t), members, ["claim_id", "service_date", "paid_amount"]),
        "contacts": co.restricted(r.contacts(t), members, ["contact_date", "status"], F.col("contact_subject") == "individual"),
        "feed": co.restricted(r.feed(t), members, ["admit_date", "setting"]),
    })


@query("k47_channel_split", r.sql(r.CONTACTS, body="""
SELECT contact_id, member_id, contact_date, CASE WHEN LOWER(direction) = 'phone call' THEN 'phone' ELSE 'sms' END AS channel
FROM contacts WHERE contact_subject = 'individual' AND LOWER(direction) IN ('phone call', 'incoming', 'outgoing')"""))
def k47(t):
    out = co.channel_split(r.contacts(t), F.col("contact_subject") == "individual", {"phone": ["phone call"], "sms": ["incoming", "outgoing"]})
    return out.select("contact_id", "member_id", "contact_date", "channel")
