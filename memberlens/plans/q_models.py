"""Training, scoring, evaluation and attribution queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.ml import attribution as at
from memberlens.ml import evaluate as ev
from memberlens.ml import isotonic as iso
from memberlens.ml import oversample as ov
from memberlens.ml import train as tr
from memberlens.operators import cohort as co
from memberlens.operators import eventlog as el
from memberlens.plans import q_history as qh
from memberlens.plans import roles as r
from memberlens.plans.catalogue_sql import member_day_sql
from memberlens.plans.registry import query
from memberlens.session import run_folder
from memberlens.sources.tables import stored

FEATURES = ["cnt_ed_7d", "cnt_click_7d", "note_health_score", "note_risk_harm_score", "note_social_stab_score",
            "note_med_adherence_score", "note_care_engagement_score", "note_program_trust_score", "note_self_score"]
LABEL = "y_any_7d"
KEYS = ["member_id", "event_date"]


def model_rows(t, horizons=(7,)) -> DataFrame:
    """Member-day features with labels and a member-level split."""
    labels = el.day_labels(el.daily_signal(qh.feed_log(t)), horizons)
    rows = qh.feed_features(t).join(labels, KEYS, "left")
    y = [c for c in labels.columns if c.startswith("y_")]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in y})
    return co.member_split(rows, {"train": 0.6, "val": 0.2, "test": 0.2})


def train_rows(t) -> DataFrame:
    return model_rows(t).where("split = 'train'")


# ---- training ------------------------------------------------------------------------------------------

@query("l1_logistic_weights")
def l1(t):
    model = tr.train_logistic(train_rows(t), FEATURES, LABEL)
    weights, intercept = tr.logistic_weights(model, FEATURES)
    return tr.ranked_weights(t.spark, {**weights, "intercept": intercept}, "coefficient")


def boosted(t):
    return tr.train_boosted(train_rows(t), FEATURES, LABEL, maxIter=5, maxDepth=3)


@query("l2_boosted_importances")
def l2(t):
    return tr.ranked_weights(t.spark, tr.importances(boosted(t), FEATURES), "importance")


@query("l3_parameter_search")
def l3(t):
    grid = tr.param_grid({"maxDepth": [2, 3], "maxIter": [3]})
    found = tr.search_boosted(train_rows(t), FEATURES, LABEL, grid, folds=2)
    return tr.search_table(t.spark, found, grid)


@query("l4_scores_all_splits")
def l4(t):
    rows = stored(model_rows(t), "model-rows")
    model = tr.train_logistic(rows.where("split = 'train'"), FEATURES, LABEL)
    return tr.labelled(tr.score(model, rows, FEATURES), "score").select(*KEYS, "split", LABEL, "score", "pred_label")


@query("l5_oversampled_minority", """
WITH c AS (SELECT COUNT(*) FILTER (label = 3) AS few, COUNT(*) FILTER (label <> 3) AS many FROM embeddings)
SELECT 1 AS label, FALSE AS synthetic, few AS n FROM c UNION ALL SELECT 0, FALSE, many FROM c UNION ALL SELECT 1, TRUE, many - few FROM c""")
def l5(t):
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 3).cast("int").alias("label"))
    return ov.oversampled(points).groupBy("label", "synthetic").agg(F.count("*").alias("n"))


SYNTHETIC = f"""
WITH own AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label = 3),
size AS (SELECT COUNT(*) FILTER (label = 3) AS few, COUNT(*) FILTER (label <> 3) AS many FROM embeddings),
distinct_vec AS (SELECT vec, MIN(id) AS rep, COUNT(*) AS copies, list_transform(vec, lambda x: floor(x * {ov.GRID})) AS g FROM own GROUP BY vec),
cell AS (SELECT rep, unnest(range(0, len(g))) AS j, unnest(g) AS x FROM distinct_vec),
centre AS (SELECT j, floor(SUM(x::BIGINT)::DOUBLE / COUNT(*)) AS c FROM cell GROUP BY j),
sign AS (
  SELECT t, b, j, CASE WHEN md5('42:' || t || ':' || b || ':' || j)[1] < '8' THEN 1 ELSE -1 END AS s
  FROM range(0, {ov.TABLES}) x(t), range(0, {ov.BITS}) y(b), (SELECT j FROM centre)),
side AS (
  SELECT rep, t, b, SUM(s * (x - c)::BIGINT) >= 0 AS up FROM cell JOIN centre USING (j) JOIN sign USING (j) GROUP BY 1, 2, 3),
code AS (SELECT rep, t, SUM(CASE WHEN up THEN 1 << ({ov.BITS} - 1 - b) ELSE 0 END) AS code FROM side GROUP BY 1, 2),
place AS (SELECT rep, t, ROW_NUMBER() OVER (PARTITION BY t ORDER BY code, rep) AS i FROM code),
visited AS (
  SELECT DISTINCT a.rep, b.rep AS neighbour FROM place a JOIN place b ON a.t = b.t AND a.rep <> b.rep AND abs(a.i - b.i) <= {ov.REACH}),
apart AS (
  SELECT v.rep, v.neighbour, b.copies, list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM visited v JOIN distinct_vec a ON a.rep = v.rep JOIN distinct_vec b ON b.rep = v.neighbour),
closest AS (
  SELECT *, SUM(copies) OVER w AS upto FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY d, neighbour) AS n FROM apart) WHERE n <= 5
  WINDOW w AS (PARTITION BY rep ORDER BY d, neighbour)),
ranked AS (
  SELECT rep, rep AS neighbour, 1 AS lo, copies - 1 AS hi FROM distinct_vec WHERE copies > 1
  UNION ALL SELECT c.rep, c.neighbour, v.copies - 1 + upto - c.copies + 1, v.copies - 1 + upto FROM closest c JOIN distinct_vec v ON v.rep = c.rep),
turn AS (
  SELECT id, vec, unnest(range(1, many // few - 1 + CASE WHEN ROW_NUMBER() OVER (ORDER BY id) <= (many - few) % few THEN 1 ELSE 0 END + 1)) AS draw, few
  FROM own, size),
draws AS (
  SELECT t.id, t.draw, v.rep, t.vec, ('0x' || md5('rank:42:' || id || ':' || draw)[1:8])::BIGINT % LEAST(5, few - 1) + 1 AS r,
         (('0x' || md5('gap:42:' || id || ':' || draw)[1:8])::BIGINT % 1000000) / 1000000.0::DOUBLE AS gap
  FROM turn t JOIN distinct_vec v ON v.vec = t.vec),
made AS (
  SELECT d.id, d.draw, k.neighbour, d.gap, list_transform(list_zip(d.vec, n.vec), lambda z: z[1] + d.gap * (z[2] - z[1])) AS vec
  FROM draws d JOIN ranked k ON k.rep = d.rep AND d.r BETWEEN k.lo AND k.hi JOIN distinct_vec n ON n.rep = k.neighbour)
SELECT id, draw::INTEGER AS draw, neighbour, gap, vec[1] AS first_component, vec[len(vec)] AS last_component,
       list_sum(list_transform(vec, lambda x: floor(x * 1000000)::BIGINT))::BIGINT AS total FROM made"""


@query("l5_synthetic_rows", SYNTHETIC)
def l5_rows(t):
    """Every synthetic row: whom it came from, its neighbour, its place between them and its components."""
    size = t.embeddings.agg(F.count_if(F.col("label") == 3).alias("few"), F.count_if(F.col("label") != 3).alias("many")).first()
    own = t.embeddings.where("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    made = ov.synthetic_rows(own, size["many"] - size["few"], size["few"])
    total = F.aggregate(F.transform("vec", lambda x: F.floor(x * 1_000_000)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("id", "draw", "neighbour", "gap", F.element_at("vec", 1).alias("first_component"), F.element_at("vec", -1).alias("last_component"), total.alias("total"))


ISOTONIC = """
m AS (SELECT {score} AS s, SUM(label) AS y, COUNT(*) AS n FROM scored WHERE split = 'val' GROUP BY 1),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY s) AS i, SUM(y) OVER (ORDER BY s) AS cy, SUM(n) OVER (ORDER BY s) AS cn FROM m),
p AS (SELECT a.i AS lo, b.i AS hi, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM o a JOIN o b ON b.i >= a.i),
g AS (SELECT lo, hi, MIN(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS low FROM p),
fit AS (SELECT s, MAX(low) AS v FROM g JOIN o ON o.i = g.hi GROUP BY s)"""
# Fixed for the comparison: a score that nearly every row has for itself.
FINE = "(o_totalprice * 100 + o_orderkey % 97 / 97.0::DOUBLE)"


@query("l6_isotonic_calibration", r.sql(r.SCORED, ISOTONIC.format(score="lr_score"), body="""
SELECT c.member_id, c.row_id, c.split, c.lr_score,
       ROUND(CASE WHEN a.s IS NULL THEN b.v WHEN b.s IS NULL OR a.s = b.s THEN a.v ELSE a.v + (c.lr_score - a.s) / (b.s - a.s) * (b.v - a.v) END, 9) AS calibrated
FROM scored c LEFT JOIN fit a ON a.s = (SELECT MAX(s) FROM fit WHERE fit.s <= c.lr_score) LEFT JOIN fit b ON b.s = (SELECT MIN(s) FROM fit WHERE fit.s >= c.lr_score)"""))
def l6(t):
    rows = r.scored(t).select("member_id", "row_id", "split", "lr_score", "label")
    return iso.calibrated(rows, F.col("split") == "val", "label", "lr_score").drop("label").withColumn("calibrated", F.round("calibrated", 9))


@query("l6_isotonic_on_validation", r.sql(r.SCORED, body="""
, m AS (SELECT lr_score AS s, SUM(label) AS y, COUNT(*) AS n FROM scored WHERE split = 'val' GROUP BY 1),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY s) AS i, SUM(y) OVER (ORDER BY s) AS cy, SUM(n) OVER (ORDER BY s) AS cn FROM m),
p AS (SELECT a.i AS lo, b.i AS hi, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM o a JOIN o b ON b.i >= a.i),
g AS (SELECT lo, hi, MIN(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS low FROM p)
SELECT s AS lr_score, ROUND(MAX(low), 9) AS calibrated FROM g JOIN o ON o.i = g.hi GROUP BY s"""))
def l6_validation(t):
    """Largest over starts of the smallest mean over ends: what pooling adjacent violators comes to."""
    rows = r.scored(t).where("split = 'val'")
    model = tr.calibrate(rows, "label", "lr_score", 1000)
    return tr.apply_calibration(model, rows.select("lr_score").distinct(), "lr_score").withColumn("calibrated", F.round("calibrated", 9))


@query("l6_isotonic_every_score", r.sql(
    r.SCORED.replace("SELECT o_custkey", "SELECT " + FINE + " AS fine_score, o_custkey"), ISOTONIC.format(score="fine_score"), body="SELECT s AS fine_score, ROUND(v, 9) AS calibrated FROM fit"))
def l6_every_score(t):
    """Blocks at every distinct score of the validation rows; nearly all of them are distinct."""
    fine = F.col("o_totalprice") * 100 + F.col("o_orderkey") % 97 / F.lit(97.0)
    scores = t.orders.select(F.col("o_orderkey").alias("row_id"), fine.alias("fine_score"))
    rows = r.scored(t).where("split = 'val'").join(scores, "row_id").select("fine_score", "label")
    found = iso.apply(iso.fit(rows, "label", "fine_score"), rows.select("fine_score").distinct(), "fine_score")
    return found.withColumn("calibrated", F.round("calibrated", 9))


# ---- evaluation ----------------------------------------------------------------------------------------

RUN = r.SCORED + """,
counts AS (SELECT split, lr_score AS s, COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1, 2),
run AS (SELECT *, SUM(pos) OVER w AS ctp, SUM(neg) OVER w AS cfp FROM counts WINDOW w AS (PARTITION BY split ORDER BY s DESC)),
sums AS (
  SELECT split, SUM(pos) AS p, SUM(neg) AS n, SUM(pos * (neg / 2.0::DOUBLE - cfp)) AS rk, SUM(pos * ctp::DOUBLE / (ctp + cfp)) AS st,
         SUM(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) AS tp, SUM(CASE WHEN s >= 0.5 THEN neg ELSE 0 END) AS fp,
         SUM(pos * LN(LEAST(GREATEST(s, 1e-15), 1 - 1e-15)) + neg * LN(1 - LEAST(GREATEST(s, 1e-15), 1 - 1e-15))) AS ll
  FROM run GROUP BY 1)"""


@query("l7_classification_metrics", r.sql(RUN, body="""
SELECT split, ROUND((rk + p::DOUBLE * n) / (p::DOUBLE * n), 9) AS roc_auc, ROUND(st / p, 9) AS pr_auc, ROUND(2.0 * tp / (2 * tp + fp + p - tp), 9)::DOUBLE AS f1,
       ROUND(tp::DOUBLE / (tp + fp), 9) AS precision, ROUND(tp::DOUBLE / p, 9) AS recall, ROUND((tp + n - fp)::DOUBLE / (p + n), 9) AS accuracy,
       tp::BIGINT AS tp, fp::BIGINT AS fp, (n - fp)::BIGINT AS tn, (p - tp)::BIGINT AS fn,
       ROUND(1 - ll / (p * LN(p::DOUBLE / (p + n)) + n * LN(1 - p::DOUBLE / (p + n))), 8) AS pseudo_r2, 0.5::DOUBLE AS threshold_used
FROM sums"""))
def l7(t):
    out = ev.classification_metrics(r.scored(t), "label", "lr_score", ["split"])
    nine = ("roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy")
    return out.withColumns({**{c: F.round(c, 9) for c in nine}, "pseudo_r2": F.round("pseudo_r2", 8)})


@query("l8_confusion", r.sql(r.SCORED, body="SELECT label AS actual, CASE WHEN lr_score >= 0.5 THEN 1 ELSE 0 END AS predicted, COUNT(*) AS n FROM scored GROUP BY 1, 2"))
def l8(t):
    return ev.confusion(tr.labelled(r.scored(t), "lr_score"), "label", "pred_label")


@query("l8_class_report", r.sql(r.SCORED, body="""
, p AS (SELECT label, CASE WHEN lr_score >= 0.5 THEN 1 ELSE 0 END AS said FROM scored), c(class) AS (VALUES (0), (1))
SELECT class, ROUND(COUNT(*) FILTER (label = class AND said = class)::DOUBLE / COUNT(*) FILTER (said = class), 9) AS precision,
       ROUND(COUNT(*) FILTER (label = class AND said = class)::DOUBLE / COUNT(*) FILTER (label = class), 9) AS recall,
       ROUND(2.0::DOUBLE * COUNT(*) FILTER (label = class AND said = class) / (COUNT(*) FILTER (said = class) + COUNT(*) FILTER (label = class)), 9) AS f1,
       COUNT(*) FILTER (label = class) AS support
FROM p CROSS JOIN c GROUP BY class"""))
def l8_report(t):
    out = ev.class_report(tr.labelled(r.scored(t), "lr_score"), "label", "pred_label")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


PR = r.SCORED + """,
c AS (SELECT lr_score AS threshold, COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
pr AS (SELECT threshold, (SUM(pos) OVER w)::BIGINT AS tp, (SUM(neg) OVER w)::BIGINT AS fp, SUM(pos) OVER () AS p FROM c WINDOW w AS (ORDER BY threshold DESC)),
tab AS (SELECT threshold, tp, fp, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall,
        2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / p) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / p + 1e-10) AS f1 FROM pr)"""


@query("l9_pr_table", r.sql(PR, body="SELECT threshold, tp, fp, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1 FROM tab"))
def l9(t):
    out = ev.pr_table(r.scored(t), "label", "lr_score")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("l9_pr_at_thresholds", r.sql(r.SCORED, body="""
, v(threshold) AS (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE))
SELECT threshold, ROUND(COUNT(*) FILTER (label = 1 AND lr_score >= threshold)::DOUBLE / COUNT(*) FILTER (lr_score >= threshold), 9) AS precision,
       ROUND(COUNT(*) FILTER (label = 1 AND lr_score >= threshold)::DOUBLE / COUNT(*) FILTER (label = 1), 9) AS recall
FROM scored CROSS JOIN v GROUP BY 1"""))
def l9_at(t):
    out = ev.pr_at(r.scored(t), "label", "lr_score")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("l10_best_threshold", r.sql(PR, body="SELECT threshold, ROUND(f1, 9) AS f1 FROM tab ORDER BY tab.f1 DESC, threshold LIMIT 1"))
def l10(t):
    return ev.best_threshold(r.scored(t), "label", "lr_score").withColumn("f1", F.round("f1", 9))


@query("l11_calibration_table", r.sql(r.SCORED, body="""
, e AS (SELECT LEAST(MIN(lr_score), MIN(xgb_score)) AS lo, (GREATEST(MAX(lr_score), MAX(xgb_score)) - LEAST(MIN(lr_score), MIN(xgb_score))) / 10 AS w FROM scored),
l AS (SELECT 'lr_score' AS model, lr_score AS s, label FROM scored UNION ALL SELECT 'xgb_score', xgb_score, label FROM scored)
SELECT model, (""" + " + ".join(f"CASE WHEN s > lo + w * {i} THEN 1 ELSE 0 END" for i in range(1, 10)) + """)::INTEGER AS bin,
       ROUND(SUM(s), 6) AS predicted_events, SUM(label)::BIGINT AS actual_events, COUNT(*) AS count, ROUND(AVG(s), 8) AS mean_score,
       ROUND(CASE WHEN SUM(s) > 0 THEN SUM(label) / SUM(s) END, 8) AS calibration
FROM l CROSS JOIN e GROUP BY 1, 2"""))
def l11(t):
    out = ev.calibration_table(r.scored(t), "label", ["lr_score", "xgb_score"])
    return out.withColumns({"predicted_events": F.round("predicted_events", 6), "mean_score": F.round("mean_score", 8), "calibration": F.round("calibration", 8)})


@query("l12_recent_consensus", r.sql(r.SCORED, body="""
SELECT member_id, month, row_id, CASE WHEN lr_score < 0.4 AND xgb_score < 0.4 THEN 'LOW' WHEN lr_score >= 0.4 AND xgb_score >= 0.4 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_classification
FROM scored WHERE month IN (SELECT DISTINCT month FROM scored ORDER BY month DESC LIMIT 3)"""))
def l12(t):
    return ev.recent_consensus(r.scored(t), "lr_score", "xgb_score").select("member_id", "month", "row_id", "risk_classification")


@query("l12_consensus_bands", r.sql(r.SCORED, body="""
SELECT row_id, CASE WHEN lr_score >= 0.65 AND xgb_score >= 0.65 THEN 'high_risk' WHEN lr_score <= 0.3 AND xgb_score <= 0.3 THEN 'low_risk' ELSE 'medium_risk' END AS consensus_risk FROM scored"""))
def l12_bands(t):
    return r.scored(t).select("row_id", ev.consensus_by_band(F.col("lr_score"), F.col("xgb_score")).alias("consensus_risk"))


@query("l13_risk_class", r.sql(r.SCORED, body="SELECT row_id, CASE WHEN lr_score >= 0.8 THEN 'high' WHEN lr_score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_class FROM scored"))
def l13(t):
    return r.scored(t).select("row_id", ev.risk_class(F.col("lr_score")).alias("risk_class"))


FIXED_WEIGHTS = {"lr_score": 1.5, "xgb_score": -0.75}


@query("l14_score_buildup", r.sql(r.SCORED, body="SELECT row_id, ROUND(0.25 + lr_score * 1.5 - xgb_score * 0.75, 9)::DOUBLE AS total_score, 3 AS parts FROM scored"))
def l14(t):
    build, total = ev.score_buildup(FIXED_WEIGHTS, 0.25)
    return r.scored(t).select("row_id", F.round(total, 9).alias("total_score"), F.json_array_length(build).alias("parts"))


@query("l14_parts", r.sql(r.SCORED, body="""
SELECT row_id, feature, ROUND(CASE feature WHEN 'intercept' THEN 1 WHEN 'lr_score' THEN lr_score ELSE xgb_score END, 9)::DOUBLE AS value,
       CASE feature WHEN 'intercept' THEN 0.25 WHEN 'lr_score' THEN 1.5 ELSE -0.75 END::DOUBLE AS coefficient,
       ROUND(CASE feature WHEN 'intercept' THEN 0.25 WHEN 'lr_score' THEN 1.5 * lr_score ELSE -0.75 * xgb_score END, 9)::DOUBLE AS contribution
FROM scored, (VALUES ('intercept'), ('lr_score'), ('xgb_score')) f(feature)"""))
def l14_parts(t):
    """The build-up itself, read back from its JSON."""
    build, _ = ev.score_buildup(FIXED_WEIGHTS, 0.25)
    part = F.from_json(build, "array<struct<feature:string,value:double,coefficient:double,contribution:double>>")
    long = r.scored(t).select("row_id", F.explode(part).alias("p")).select("row_id", "p.*")
    return long.select("row_id", "feature", F.round("value", 9).alias("value"), "coefficient", F.round("contribution", 9).alias("contribution"))


def explained(t):
    return explained_once(t).drop("raw")


@query("l15_local_factors")
def l15(t):
    moved = explained(t)
    out = at.local_factors(moved, FEATURES, KEYS, top_n=3)
    return out.select(*KEYS, "base_value", F.to_json("increasing_factors").alias("increasing_factors"),
                      F.to_json("decreasing_factors").alias("decreasing_factors"), "margin")


@query("l20_key_drivers")
def l20_drivers(t):
    return at.key_drivers(explained(t), FEATURES, KEYS).select(*KEYS, F.to_json("key_drivers").alias("key_drivers"))


@query("l16_global_factors")
def l16(t):
    return at.global_factors(explained(t), FEATURES)


@query("l17_background_sample", "SELECT c_custkey, c_acctbal FROM customer WHERE CAST('0x' || SUBSTR(MD5(c_custkey || ':42'), 1, 8) AS BIGINT) < 429496730")
def l17(t):
    return at.background_sample(t.customer.select("c_custkey", "c_acctbal"), 0.1, "c_custkey")


@query("l18_ranked_weights")
def l18(t):
    rows = train_rows(t)
    weights, _ = tr.logistic_weights(tr.train_logistic(rows, FEATURES, LABEL), FEATURES)
    a = tr.ranked_weights(t.spark, weights, "value").withColumn("model", F.lit("logistic"))
    b = tr.ranked_weights(t.spark, tr.importances(boosted(t), FEATURES), "value").withColumn("model", F.lit("boosted"))
    return a.unionByName(b)


@query("l19_consolidated_individuals", r.sql(r.SCORED, body="""
SELECT member_id, month, split, label AS actual_event, lr_score AS logistic_prob, xgb_score AS boosted_prob,
       CASE WHEN lr_score >= 0.8 THEN 'high' WHEN lr_score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_class,
       ROUND(0.25 + lr_score * 1.5 - xgb_score * 0.75, 9)::DOUBLE AS logistic_total_score
FROM scored WHERE month >= DATE '1996-01-01'"""))
def l19(t):
    out = ev.consolidated_individuals(r.scored(t), "label", "lr_score", "xgb_score", ev.score_buildup(FIXED_WEIGHTS, 0.25), "1996-01-01")
    return out.drop("logistic_score_build").withColumn("logistic_total_score", F.round("logistic_total_score", 9))


SUMMARY = """
SELECT month, CASE WHEN lr_score >= 0.8 THEN 'high' WHEN lr_score >= 0.5 THEN 'medium' ELSE 'low' END AS predicted_risk, COUNT(*) AS total_members,
       CAST(SUM(CAST(lr_score AS DECIMAL(9,3))) AS DOUBLE) AS total_predicted_events,
       CAST(SUM(CAST(lr_score AS DECIMAL(9,3))) AS DOUBLE) / COUNT(*) AS average_risk_score, SUM(label)::BIGINT AS total_actual_events
FROM scored {where} GROUP BY 1, 2"""


def _summary(df):
    rows = df.withColumn("predicted_risk", ev.risk_class(F.col("lr_score"))).withColumn("lr_score", F.col("lr_score").cast("decimal(9,3)"))
    out = ev.class_summary(rows, ["month", "predicted_risk"], "lr_score", "label")
    return out.withColumn("total_predicted_events", F.col("total_predicted_events").cast("double"))


@query("d21_class_summary", r.sql(r.SCORED, body=SUMMARY.format(where="")))
def d21(t):
    return _summary(r.scored(t))


@query("l20_recent_summary", r.sql(r.SCORED, body=SUMMARY.format(where="WHERE month BETWEEN DATE '2001-01-01' AND DATE '2001-06-01'")))
def l20(t):
    return _summary(ev.recent_report(r.scored(t), "2001-01-01", "2001-06-01"))


@query("l20_recent_report", r.sql(r.SCORED, body="SELECT member_id, month, row_id, lr_score FROM scored WHERE month BETWEEN DATE '2001-01-01' AND DATE '2001-06-01'"))
def l20_report(t):
    return ev.recent_report(r.scored(t), "2001-01-01", "2001-06-01").select("member_id", "month", "row_id", "lr_score")


@query("l21_feature_ablation")
def l21(t):
    groups = {"lagged": ["cnt_ed_7d"], "operational": ["cnt_click_7d"], "notes": [f for f in FEATURES if f.startswith("note_")]}
    rows = stored(model_rows(t), "model-rows")
    out = []
    for name, features in tr.ablations(FEATURES + ["note_self_score"], {k: v for k, v in groups.items() if k != "notes"}).items():
        kept = list(dict.fromkeys(features))
        scored = tr.score(tr.train_logistic(rows.where("split = 'train'"), kept, LABEL, max_iter=30), rows, kept)
        metrics = ev.classification_metrics(scored, LABEL, "score", ["split"])
        out.append(metrics.select(F.lit(name).alias("horizon"), F.lit(len(kept)).alias("n_features"), "split", "roc_auc", "pr_auc"))
    return reduce(DataFrame.unionByName, out)


@query("l22_targets")
def l22(t):
    rows = stored(model_rows(t, (7, 14)), "model-rows")
    out = []
    for target in [f"y_{k}_{n}d" for n in (7, 14) for k in ("any", "ed", "ip")]:
        model = tr.train_logistic(rows.where("split = 'train'"), FEATURES, target, max_iter=20)
        metrics = ev.classification_metrics(tr.score(model, rows, FEATURES), target, "score", ["split"])
        out.append(metrics.select(F.lit(target).alias("target"), "split", "roc_auc", "pr_auc", "f1"))
    return reduce(DataFrame.unionByName, out)


@query("d22_class_weights", "SELECT quality, COUNT(*) AS n, (SELECT COUNT(*) FILTER (quality = 0)::DOUBLE / COUNT(*) FILTER (quality = 1) FROM labels) AS neg_per_pos FROM labels GROUP BY 1")
def d22(t):
    return tr.class_counts(t.labels, "quality").withColumnRenamed("label", "quality")


# ---- checks of fitted models ---------------------------------------------------------------------------
# A fit cannot be written in SQL, but what makes it right can be checked row by row. These queries fit once, hold the result
# against its definition in Spark, and give rows and counts that SQL can state.

MODEL_ROWS = """
model AS (
  SELECT member_id, event_date, y_any_7d, y_ed_7d, y_ip_7d, y_any_14d, y_ed_14d, y_ip_14d,
         CASE WHEN b < 2576980378 THEN 'train' WHEN b < 3435973837 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || SUBSTR(MD5(member_id::VARCHAR), 1, 8))::BIGINT AS b FROM day_table))"""
NAMED = "(SELECT UNNEST([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature)"
TARGETS = [f"y_{k}_{n}d" for n in (7, 14) for k in ("any", "ed", "ip")]
ABLATED = tr.ablations(FEATURES, {"lagged": ["cnt_ed_7d"], "operational": ["cnt_click_7d"]})


def checked_sql(body: str) -> str:
    return member_day_sql("," + MODEL_ROWS + body)


def near(a, b, within: float = 1e-9):
    return F.abs(a - b) <= F.lit(within) * F.greatest(F.lit(1.0), F.abs(b))


def linear(model):
    """The margin of a fitted logistic regression, from its coefficients in units of the features."""
    weights, intercept = tr.logistic_weights(model, FEATURES)
    return sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in weights.items()), F.lit(intercept))


@query("l1_logistic_optimum", checked_sql(f"""
SELECT feature, COUNT(*) AS n_rows, COUNT(*) FILTER (y_any_7d = 1) AS n_positive, TRUE AS is_stationary
FROM model, (SELECT feature FROM {NAMED} UNION ALL SELECT 'intercept') WHERE split = 'train' GROUP BY 1"""))
def l1_optimum(t):
    """Weighted residual sums per feature: at the optimum each equals minus the penalty's slope."""
    rows = stored(train_rows(t), "model-rows")
    model = tr.train_logistic(rows, FEATURES, LABEL)
    weights, _ = tr.logistic_weights(model, FEATURES)
    neg, pos = tr.class_sizes(rows, LABEL)
    n = neg + pos
    residual = (1 / (1 + F.exp(-linear(model))) - F.col(LABEL)) * F.when(F.col(LABEL) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * neg))
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES}
    wide = rows.select(residual.alias("_r"), *[x[f].alias(f) for f in FEATURES]).agg(
        (F.sum("_r") / n).alias("intercept"), *[(F.sum(F.col("_r") * F.col(f)) / n).alias(f) for f in FEATURES], *[F.stddev_samp(f).alias(f"_sd_{f}") for f in FEATURES])
    slopes = F.array(F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("slope")), *[
        F.struct(F.lit(f).alias("feature"), F.when(F.col(f"_sd_{f}") > 0, F.col(f) / F.col(f"_sd_{f}") + F.lit(weights[f] / n) * F.col(f"_sd_{f}")).otherwise(0.0).alias("slope")) for f in FEATURES])
    long = wide.select(F.explode(slopes).alias("r")).select("r.*")
    return long.select("feature", F.lit(n).cast("bigint").alias("n_rows"), F.lit(pos).cast("bigint").alias("n_positive"), (F.abs("slope") < 1e-3).alias("is_stationary"))


@query("l2_importances_from_nodes", f"SELECT feature, TRUE AS matches, TRUE AS is_share FROM {NAMED}")
def l2_nodes(t):
    """Importances against the gains of the trees' own nodes, weighted by the rows that reached them."""
    rows = stored(train_rows(t), "model-rows")
    model = tr.train_boosted(rows, FEATURES, LABEL, maxIter=5, maxDepth=3)
    folder = run_folder(t.spark, "trees")
    model.stages[-1].save(folder)
    nodes = t.spark.read.parquet(f"{folder}/data").select("nodeData.*").where("leftChild >= 0")
    gains = nodes.groupBy(F.col("split.featureIndex").alias("i")).agg(F.sum(F.col("gain") * F.col("impurityStats")[0]).alias("g"))
    total = gains.agg(F.sum("g")).scalar()
    said = t.spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(tr.importances(model, FEATURES).items())], "i int, feature string, importance double")
    share = F.coalesce(F.col("g") / total, F.lit(0.0))
    return said.join(gains, "i", "left").select("feature", near(F.col("importance"), share).alias("matches"), F.col("importance").between(0, 1).alias("is_share"))


@query("l3_search_order", """
SELECT 0 AS candidate, 'maxDepth=2, maxIter=3' AS params, TRUE AS is_auc, TRUE AS in_order UNION ALL SELECT 1, 'maxDepth=3, maxIter=3', TRUE, TRUE""")
def l3_order(t):
    found = stored(l3(t), "search")
    ahead = found.agg(F.max("mean_roc_auc")).scalar()
    least = found.agg(F.min("mean_roc_auc")).scalar()
    return found.select("candidate", "params", F.col("mean_roc_auc").between(0.5, 1).alias("is_auc"), F.col("mean_roc_auc").between(least, ahead).alias("in_order"))


@query("l4_scores_from_weights", checked_sql("SELECT member_id, event_date, split, y_any_7d, TRUE AS score_matches, TRUE AS label_follows FROM model"))
def l4_weights(t):
    """Scores of all splits against the logistic of weights and features."""
    rows = stored(model_rows(t), "model-rows")
    model = tr.train_logistic(rows.where("split = 'train'"), FEATURES, LABEL)
    out = tr.labelled(tr.score(model, rows, FEATURES), "score")
    return out.select(*KEYS, "split", LABEL, near(F.col("score"), 1 / (1 + F.exp(-linear(model))), 1e-8).alias("score_matches"),
                      (F.col("pred_label") == (F.col("score") >= 0.5).cast("int")).alias("label_follows"))


def explained_once(t):
    """Rows, a boosted model fitted on their train part, and stored contributions with the model's own margin beside them."""
    rows = stored(model_rows(t), "model-rows")
    model = tr.train_boosted(rows.where("split = 'train'"), FEATURES, LABEL, maxIter=5, maxDepth=3)
    raw = model.transform(tr.filled(rows, FEATURES)).select(*KEYS, vector_to_array("rawPrediction")[1].alias("raw"))
    return stored(at.local_contributions(model, rows, FEATURES, KEYS).join(raw, KEYS), "contributions")


@query("l15_factors_add_up", checked_sql("SELECT member_id, event_date, TRUE AS margin_matches, TRUE AS factors_match FROM model"))
def l15_add_up(t):
    """Base and contributions against the model's raw prediction; factors against the contributions they were picked from."""
    moved = explained_once(t)
    factors = at.local_factors(moved, FEATURES, KEYS, top_n=len(FEATURES), epsilon=0.0)
    up = F.aggregate("increasing_factors", F.lit(0.0), lambda a, x: a + x["contribution"])
    down = F.aggregate("decreasing_factors", F.lit(0.0), lambda a, x: a + x["contribution"])
    picked = factors.select(*KEYS, (F.col("base_value") + up + down).alias("total"))
    return moved.join(picked, KEYS).select(*KEYS, near(F.col("margin"), F.col("raw")).alias("margin_matches"), near(F.col("total"), F.col("raw")).alias("factors_match"))


@query("l16_means_from_rows", f"SELECT feature, TRUE AS matches FROM {NAMED}")
def l16_rows(t):
    """Global factors against the mean over exploded contributions."""
    moved = explained_once(t)
    long = moved.select(F.posexplode("contributions").alias("i", "c")).groupBy("i").agg(F.avg(F.abs("c")).alias("mean"))
    names = F.array(*[F.lit(f) for f in FEATURES])
    said = at.global_factors(moved, FEATURES)
    both = long.withColumn("feature", names[F.col("i")]).join(said, "feature", "left")
    return both.select("feature", F.coalesce(near(F.col("mean_abs_contribution"), F.col("mean")), F.col("mean") < 1e-6).alias("matches"))


@query("l18_ranks_in_order", f"SELECT model, feature, TRUE AS rank_matches FROM {NAMED}, (VALUES ('logistic'), ('boosted')) m(model)")
def l18_order(t):
    """Ranks against the number of features with a larger absolute weight."""
    rows = stored(l18(t), "weights")
    other = rows.select(F.col("model").alias("_m"), F.col("feature").alias("_f"), F.abs("value").alias("_v"))
    ahead = (F.col("_v") > F.abs("value")) | ((F.col("_v") == F.abs("value")) & (F.col("_f") < F.col("feature")))
    counted = rows.join(other, (F.col("model") == F.col("_m")) & ahead, "left").groupBy("model", "feature", "rank").agg(F.count("_f").alias("n"))
    return counted.select("model", "feature", (F.col("rank") == F.col("n") + 1).alias("rank_matches"))


@query("l20_drivers_are_largest", checked_sql("SELECT member_id, event_date, 3 AS n_drivers, TRUE AS are_largest FROM model"))
def l20_largest(t):
    moved = explained_once(t)
    drivers = at.key_drivers(moved, FEATURES, KEYS).join(moved.select(*KEYS, "contributions"), KEYS)
    sizes = F.transform("key_drivers", lambda d: F.abs(d["contribution"]))
    largest = F.slice(F.reverse(F.array_sort(F.transform("contributions", lambda c: F.abs(c)))), 1, 3)
    return drivers.select(*KEYS, F.size("key_drivers").alias("n_drivers"), (sizes == largest).alias("are_largest"))


def auc_rows(rows, name, value, features, target, max_iter):
    """Counts per split, and whether the area under the curve is that of MLlib's evaluator."""
    scored = stored(tr.score(tr.train_logistic(rows.where("split = 'train'"), features, target, max_iter=max_iter), rows, features).select("split", target, "score"), "scores")
    other = {s: BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=target, numBins=0).evaluate(scored.where(F.col("split") == s)) for s in ("train", "val", "test")}
    theirs = F.create_map(*[x for s, v in other.items() for x in (F.lit(s), F.lit(v))])
    found = ev.classification_metrics(scored, target, "score", ["split"])
    return found.select(F.lit(value).alias(name), F.lit(len(features)).alias("n_features"), "split", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"),
                        near(F.col("roc_auc"), theirs[F.col("split")], 1e-9).alias("auc_matches"))


@query("l21_ablation_areas", checked_sql(f"""
SELECT horizon, n_features, split, COUNT(*) FILTER (y_any_7d = 1) AS positives, COUNT(*) FILTER (y_any_7d = 0) AS negatives, TRUE AS auc_matches
FROM model, (VALUES {", ".join(f"('{h}', {len(f)})" for h, f in ABLATED.items())}) h(horizon, n_features) GROUP BY 1, 2, 3"""))
def l21_areas(t):
    rows = stored(model_rows(t), "model-rows")
    return reduce(DataFrame.unionByName, [auc_rows(rows, "horizon", h, f, LABEL, 30) for h, f in ABLATED.items()])


@query("l22_target_areas", checked_sql(" UNION ALL ".join(
    f"SELECT '{y}' AS target, {len(FEATURES)} AS n_features, split, COUNT(*) FILTER ({y} = 1) AS positives, COUNT(*) FILTER ({y} = 0) AS negatives, TRUE AS auc_matches FROM model GROUP BY 3" for y in TARGETS)))
def l22_areas(t):
    rows = stored(model_rows(t, (7, 14)), "model-rows")
    return reduce(DataFrame.unionByName, [auc_rows(rows, "target", y, FEATURES, y, 20) for y in TARGETS])


@query("l19_individuals_with_buildups", checked_sql("""
SELECT member_id, event_date, split, y_any_7d AS actual_event, TRUE AS logistic_adds_up, TRUE AS boosted_adds_up, TRUE AS class_follows FROM model WHERE event_date >= DATE '2024-01-05'"""))
def l19_buildups(t):
    """Individuals of all splits with both scores and both build-ups, from two fitted models; each build-up adds up to its score."""
    rows = stored(model_rows(t), "model-rows")
    train = rows.where("split = 'train'")
    logistic, trees = tr.train_logistic(train, FEATURES, LABEL), tr.train_boosted(train, FEATURES, LABEL, maxIter=5, maxDepth=3)
    scored = tr.score(trees, tr.score(logistic, rows, FEATURES, "lr"), FEATURES, "xgb")
    moved = at.local_contributions(trees, rows, FEATURES, KEYS)
    factors = at.local_factors(moved, FEATURES, KEYS, top_n=len(FEATURES), epsilon=0.0).select(*KEYS, "base_value", "increasing_factors", "decreasing_factors")
    out = ev.consolidated_individuals(scored, LABEL, "lr", "xgb", ev.score_buildup(*tr.logistic_weights(logistic, FEATURES)), "2024-01-05", "event_date", boosted=factors)
    lists = "array<struct<feature:string,contribution:double>>"
    boosted = F.from_json("boosted_score_build", f"base_value double, increasing_factors {lists}, decreasing_factors {lists}")
    parts = F.from_json("logistic_score_build", "array<struct<contribution:double>>")

    def total(found):
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x["contribution"])

    def logit(p):
        return F.ln(F.col(p) / (1 - F.col(p)))

    # boosted probabilities are the logistic of twice the margin
    return out.withColumn("b", boosted).select(
        *KEYS, "split", "actual_event", (near(total(parts), F.col("logistic_total_score")) & near(F.col("logistic_total_score"), logit("logistic_prob"), 1e-6)).alias("logistic_adds_up"),
        near(2 * (F.col("b.base_value") + total(F.col("b.increasing_factors")) + total(F.col("b.decreasing_factors"))), logit("boosted_prob"), 1e-6).alias("boosted_adds_up"),
        (F.col("risk_class") == ev.risk_class(F.col("logistic_prob"))).alias("class_follows"))
