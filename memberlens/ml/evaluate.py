"""Evaluation of scored rows.

Everything starts from one row per distinct score with its positives and negatives, so a score shared by many rows
costs nothing, and running totals are built over score ranges instead of in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.expr import priority_label, ratio
from memberlens.operators.tabular import latest_periods
from memberlens.operators.windows import running_totals

CLIP = 1e-15


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (and group); rows without label or score are left out."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def pr_table(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Precision, recall and F1 of predicting positive at or above each distinct score."""
    run = running_totals(score_counts(df, label, score, by), "threshold", ["pos", "neg"], True, buckets, by=by)
    totals = score_counts(df, label, score, by).groupBy(*by).agg(F.sum("pos").alias("_all"))
    joined = run.join(totals, list(by)) if by else run.withColumn("_all", totals.scalar())
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision, recall = ratio(tp, tp + fp), ratio(tp, "_all")
    return joined.select(
        *by, "threshold", tp.alias("tp"), fp.alias("fp"), precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / (precision + recall + F.lit(1e-10))).alias("f1"),
    )


def pr_at(df: DataFrame, label: str, score: str, points: Sequence[float] = (0.2, 0.5, 0.8)) -> DataFrame:
    """Precision and recall at fixed thresholds, one row each."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    is_pos = F.col(label) == 1
    wide = counts.agg(
        F.count_if(is_pos).alias("p"),
        *[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(is_pos & (F.col(score) >= t)).alias("tp"),
                   F.count_if(F.col(score) >= t).alias("n")).alias(f"t{i}") for i, t in enumerate(points)])
    rows = wide.select("p", F.explode(F.array(*[f"t{i}" for i in range(len(points))])).alias("r"))
    return rows.select("r.threshold", ratio("r.tp", "r.n").alias("precision"), ratio("r.tp", "p").alias("recall"))


def classification_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5,
                           buckets: int | None = None) -> DataFrame:
    """All classification metrics per group in one pass over the distinct scores.

    ROC-AUC averages ties; average precision is the step sum; pseudo R² is one minus the ratio of the log likelihoods
    of the scores and of the base rate. A metric that is undefined (one class only) is NULL.
    """
    run = running_totals(score_counts(df, label, score, by), "threshold", ["pos", "neg"], True, buckets, by=by)
    pos, neg, s = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("threshold")
    tp_run, fp_run = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    p = F.least(F.greatest(s.cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    hit = s >= threshold
    sums = run.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(pos * (neg / 2 - fp_run)).alias("_rank"), F.sum(pos * tp_run / (tp_run + fp_run)).alias("_steps"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(pos * F.ln(p) + neg * F.ln(1 - p)).alias("_ll"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    pn = F.col("P").cast("double") * F.col("N")
    base = ratio("P", F.col("P") + F.col("N"))
    null_ll = F.col("P") * F.ln(base) + F.col("N") * F.ln(1 - base)
    two = pn > 0
    return sums.select(
        *by,
        F.when(two, (F.col("_rank") + pn) / pn).alias("roc_auc"),
        F.when(two, F.col("_steps") / F.col("P")).alias("pr_auc"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        ratio(tp + tn, F.col("P") + F.col("N")).alias("accuracy"),
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.when(two, 1 - F.col("_ll") / null_ll).alias("pseudo_r2"),
        F.lit(float(threshold)).alias("threshold_used"),
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    cells = confusion(df, label, predicted)
    wide = cells.agg(*[
        F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(f"{word}_{c}") for c in classes for word, cond in (
            ("hit", (F.col("actual") == c) & (F.col("predicted") == c)), ("said", F.col("predicted") == c), ("are", F.col("actual") == c))])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"hit_{c}").alias("hit"), F.col(f"said_{c}").alias("said"), F.col(f"are_{c}").alias("support"))
        for c in classes])).alias("r")).select("r.*")
    zero = F.lit(0.0)
    return rows.select("class", F.coalesce(ratio("hit", "said"), zero).alias("precision"), F.coalesce(ratio("hit", "support"), zero).alias("recall"),
                       F.coalesce(ratio(2 * F.col("hit"), F.col("said") + F.col("support")), zero).alias("f1"), "support")


def best_threshold(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Threshold of the largest F1, the lowest one among equals."""
    table = pr_table(df, label, score, buckets=buckets)
    best = table.agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"))


def calibration_table(df: DataFrame, label: str, scores: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins on edges shared by all score columns: predicted and actual events, count, mean and their ratio.

    Bins are closed on the right and the first one holds the smallest score. Edges come from one aggregate row.
    """
    lo = F.least(*[F.min(s) for s in scores], F.lit(float("inf")))
    hi = F.greatest(*[F.max(s) for s in scores], F.lit(float("-inf")))
    edges = df.agg(F.struct(lo.alias("lo"), ((hi - lo) / F.lit(bins)).alias("_width")).alias("e"))
    base = df.select(F.col(label).alias("_y"), *scores, edges.scalar().alias("_e")).select("_y", *scores, "_e.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores]))
    long = base.select("_y", "lo", "_width", pairs.alias("_p")).select("_y", "lo", "_width", "_p.*").where(F.col("score").isNotNull())
    above = F.lit(0)
    for i in range(1, bins):
        above = above + F.when(F.col("score") > F.col("lo") + F.col("_width") * F.lit(i), 1).otherwise(0)
    return long.withColumn("bin", above).groupBy("model", "bin").agg(
        F.sum("score").alias("predicted_events"), F.sum("_y").alias("actual_events"), F.count("*").alias("count"),
        F.avg("score").alias("mean_score"),
    ).withColumn("calibration", F.when(F.col("predicted_events") > 0, F.col("actual_events") / F.col("predicted_events")))


def consensus(first: Column, second: Column, cut: float = 0.4) -> Column:
    """HIGH when both scores reach the cut, LOW when neither does, else MEDIUM."""
    return priority_label([((first < cut) & (second < cut), "LOW"), ((first >= cut) & (second >= cut), "HIGH")], "MEDIUM")


def consensus_by_band(first: Column, second: Column, low: float = 0.3, high: float = 0.65) -> Column:
    return priority_label([((first >= high) & (second >= high), "high_risk"), ((first <= low) & (second <= low), "low_risk")],
                          "medium_risk")


def recent_consensus(df: DataFrame, first: str, second: str, period: str = "month", k: int = 3, cut: float = 0.4) -> DataFrame:
    """Consensus class of the rows in the latest ``k`` periods."""
    return latest_periods(df, period, k).withColumn("risk_classification", consensus(F.col(first), F.col(second), cut))


def risk_class(score: Column, medium: float = 0.5, high: float = 0.8) -> Column:
    return priority_label([(score >= high, "high"), (score >= medium, "medium")], "low")


def class_summary(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Rows, predicted events, mean score and actual events per group."""
    return df.groupBy(*by).agg(F.count("*").alias("total_members"), F.sum(score).alias("total_predicted_events"),
                               (F.sum(score).cast("double") / F.count(score)).alias("average_risk_score"),
                               F.sum(label).alias("total_actual_events"))


def recent_report(df: DataFrame, start: str, end: str, month: str = "month") -> DataFrame:
    """Rows of the reporting window, in member and month order."""
    inside = (F.col(month) >= F.lit(start).cast("date")) & (F.col(month) <= F.lit(end).cast("date"))
    return df.where(inside).orderBy("member_id", month)


def score_buildup(weights: Mapping[str, float], intercept: float) -> tuple[Column, Column]:
    """Value, coefficient and contribution per feature (and intercept) as JSON, and their total."""
    def part(name: str, value: Column, weight: float) -> Column:
        return F.struct(F.lit(name).alias("feature"), value.alias("value"), F.lit(float(weight)).alias("coefficient"),
                        (value * F.lit(float(weight))).alias("contribution"))

    parts = [part("intercept", F.lit(1.0), intercept)] + [
        part(f, F.coalesce(F.col(f).cast("double"), F.lit(0.0)), w) for f, w in weights.items()]
    total = parts[0]["contribution"]
    for p in parts[1:]:
        total = total + p["contribution"]
    return F.to_json(F.array(*parts)), total


def consolidated_individuals(scored: DataFrame, label: str, first: str, second: str, build: tuple[Column, Column] | None = None,
                             since: str | None = None, month: str = "month", boosted: DataFrame | None = None) -> DataFrame:
    """One row per member and month of all splits with both scores, the class and the score build-ups.

    ``boosted`` holds the local factors of the second model per member and month; they are attached as JSON.
    """
    rows = scored if since is None else scored.where(F.col(month) >= F.lit(since).cast("date"))
    out = [F.col("member_id"), F.col(month), F.col("split"), F.col(label).alias("actual_event"), F.col(first).alias("logistic_prob"),
           F.col(second).alias("boosted_prob"), risk_class(F.col(first)).alias("risk_class")]
    if build:
        out += [build[0].alias("logistic_score_build"), build[1].alias("logistic_total_score")]
    if boosted is not None:
        parts = [c for c in boosted.columns if c not in ("member_id", month)]
        factors = boosted.select("member_id", month, F.to_json(F.struct(*parts)).alias("boosted_score_build"))
        rows = rows.join(factors, ["member_id", month], "left")
        out.append(F.col("boosted_score_build"))
    return rows.select(*out)
