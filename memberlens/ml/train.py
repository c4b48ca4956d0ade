"""Training, search and scoring with MLlib estimators."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.operators.cohort import member_bucket
from memberlens.session import ensure_checkpoint_dir


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, with the number of negatives per positive beside them."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    ratio = counts.agg(F.try_divide(F.sum(F.when(F.col("label") == 0, F.col("n"))).cast("double"),
                                    F.sum(F.when(F.col("label") == 1, F.col("n"))).cast("double")).alias("r"))
    return counts.withColumn("neg_per_pos", ratio.scalar())


def filled(df: DataFrame, features: Sequence[str], how: str = "zero") -> DataFrame:
    """Missing features as 0 or as the column mean; all as doubles."""
    numbers = df.withColumns({f: F.col(f).cast("double") for f in features})
    if how == "zero":
        return numbers.na.fill(0.0, list(features))
    if how == "mean":
        return Imputer(inputCols=list(features), outputCols=list(features), strategy="mean").fit(numbers).transform(numbers)
    raise ValueError(f"unknown filling {how!r}")


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """Numbers of negatives and positives."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return row["neg"], row["pos"]


def with_weights(df: DataFrame, label: str, sizes: tuple[int, int], kind: str = "balanced", column: str = "_weight") -> DataFrame:
    """``balanced`` gives both classes the same total weight; ``positive`` weighs positives by negatives per positive."""
    neg, pos = sizes
    if kind == "balanced":
        per = {c: (pos + neg) / (2.0 * m) if m else 1.0 for c, m in ((1, pos), (0, neg))}
    elif kind == "positive":
        per = {1: neg / pos if pos and neg else 1.0, 0: 1.0}
    elif kind == "none":
        per = {1: 1.0, 0: 1.0}
    else:
        raise ValueError(f"unknown weighting {kind!r}")
    return df.withColumn(column, F.when(F.col(label) == 1, F.lit(per[1])).otherwise(F.lit(per[0])))


@contextmanager
def training_rows(train: DataFrame, features: Sequence[str], label: str, extra: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The columns a fit needs, kept for its several passes and released after it."""
    rows = filled(train, features).select(*features, label, *extra).where(F.col(label).isNotNull()).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def train_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, max_iter: int = 100,
                   weighting: str = "balanced", scaled: bool = True) -> PipelineModel:
    """L2 logistic regression on features divided by their deviation, with balanced class weights.

    ``c`` is the inverse penalty on the summed loss; MLlib penalises the mean loss, hence the division by the rows.
    """
    with training_rows(train, features, label) as rows:
        sizes = class_sizes(rows, label)
        stages: list = [VectorAssembler(inputCols=list(features), outputCol="_raw")]
        if scaled:
            stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=False, withStd=True))
        stages.append(LogisticRegression(
            featuresCol="_scaled" if scaled else "_raw", labelCol=label, weightCol="_weight",
            regParam=1.0 / (c * max(sum(sizes), 1)), elasticNetParam=0.0, maxIter=max_iter, tol=1e-6, standardization=False))
        return Pipeline(stages=stages).fit(with_weights(rows, label, sizes, weighting))


def boosted_trees(label: str, seed: int = 42, **params) -> GBTClassifier:
    """Gradient-boosted trees; long chains are cut by reliable checkpoints in the shared folder."""
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "checkpointInterval": 10, **params}
    return GBTClassifier(featuresCol="_raw", labelCol=label, weightCol="_weight", seed=seed, cacheNodeIds=True, **settings)


def train_boosted(train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **params) -> PipelineModel:
    """Boosted trees with positives weighted by negatives per positive."""
    ensure_checkpoint_dir(train.sparkSession)
    with training_rows(train, features, label) as rows:
        data = with_weights(rows, label, class_sizes(rows, label), "positive")
        assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
        return Pipeline(stages=[assembler, boosted_trees(label, seed, **params)]).fit(data)


def param_grid(options: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    grid: list[dict] = [{}]
    for name, values in options.items():
        grid = [{**g, name: v} for g in grid for v in values]
    return grid


def random_params(draws: Mapping[str, Callable[[random.Random], object]], n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded draws; each parameter has a function from a random generator to a value."""
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in draws.items()} for _ in range(n)]


BOOSTED_DRAWS: dict[str, Callable[[random.Random], object]] = {
    "maxIter": lambda g: g.randrange(50, 300),
    "maxDepth": lambda g: g.randrange(3, 10),
    "stepSize": lambda g: g.uniform(0.01, 0.31),
    "subsamplingRate": lambda g: g.uniform(0.6, 1.0),
}


def search_boosted(train: DataFrame, features: Sequence[str], label: str, candidates: Sequence[dict], folds: int = 3,
                   key: str = "member_id", seed: int = 42, parallelism: int = 2) -> CrossValidatorModel:
    """Cross-validated choice among parameter sets by ROC-AUC; all rows of a member share a fold."""
    ensure_checkpoint_dir(train.sparkSession)
    estimator = boosted_trees(label, seed)
    maps = [{estimator.getParam(name): value for name, value in c.items()} for c in candidates]
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    with training_rows(train, features, label, [key]) as rows:
        data = with_weights(rows, label, class_sizes(rows, label), "positive").withColumn(
            "_fold", member_bucket(key, f"fold{seed}", folds).cast("int"))
        ready = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(data)
        return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                              foldCol="_fold", parallelism=parallelism, seed=seed).fit(ready)


def search_table(spark, model: CrossValidatorModel, candidates: Sequence[dict]) -> DataFrame:
    """Mean ROC-AUC per candidate, best first."""
    rows = [(i, float(m), ", ".join(f"{k}={v}" for k, v in sorted(c.items()))) for i, (m, c) in enumerate(zip(model.avgMetrics, candidates))]
    return spark.createDataFrame(rows, "candidate int, mean_roc_auc double, params string").orderBy(F.desc("mean_roc_auc"), "candidate")


def score(model: Model, df: DataFrame, features: Sequence[str], name: str = "score") -> DataFrame:
    """Probability of the positive class for all rows (and so for all splits at once)."""
    out = model.transform(filled(df, features))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def labelled(df: DataFrame, score_column: str, threshold: float = 0.5, name: str = "pred_label") -> DataFrame:
    return df.withColumn(name, (F.col(score_column) >= threshold).cast("int"))


def calibrate(scored: DataFrame, label: str, score_column: str = "score", steps: int = 10_000):
    """Isotonic map from score to observed rate, fitted on validation rows.

    Scores are put on a grid of ``steps`` per unit and rows of one grid point merged into one weighted row, so the fit, which
    gathers what it pools on the driver, sees a bounded number of rows however many are scored.
    """
    grid = (F.round(F.col(score_column) * steps) / steps).alias("_s")
    merged = scored.where(F.col(label).isNotNull() & F.col(score_column).isNotNull()).groupBy(grid).agg(
        F.avg(F.col(label).cast("double")).alias("_rate"), F.count("*").cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_s", labelCol="_rate", weightCol="_n", predictionCol="calibrated").fit(merged)


def apply_calibration(model, scored: DataFrame, score_column: str = "score", name: str = "calibrated") -> DataFrame:
    out = model.transform(scored.withColumn("_s", F.col(score_column)))
    return out.withColumnRenamed("calibrated", name).drop("_s") if name != "calibrated" else out.drop("_s")


def logistic_weights(model: PipelineModel, features: Sequence[str]) -> tuple[dict[str, float], float]:
    """Coefficients in units of the unscaled features, and the intercept."""
    fitted = model.stages[-1]
    weights = [float(w) for w in fitted.coefficients]
    for stage in model.stages:
        if hasattr(stage, "std") and hasattr(stage, "withStd"):
            weights = [w / float(s) if s else 0.0 for w, s in zip(weights, stage.std)]
    return dict(zip(features, weights)), float(fitted.intercept)


def ranked_weights(spark, values: Mapping[str, float], name: str = "weight") -> DataFrame:
    """Feature weights or importances, largest absolute value first."""
    rows = sorted(((f, float(v)) for f, v in values.items()), key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame([(f, v, i) for i, (f, v) in enumerate(rows, start=1)], f"feature string, {name} double, rank int")


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def ablations(features: Sequence[str], groups: Mapping[str, Iterable[str]]) -> dict[str, list[str]]:
    """Feature lists with growing sets of exclusion groups lifted: horizon 0 excludes all, the last none."""
    names = list(groups)
    out = {}
    for i in range(len(names) + 1):
        banned = {c.lower() for g in names[i:] for c in groups[g]}
        out[f"horizon_{i}"] = [f for f in features if f.lower() not in banned]
    return out
