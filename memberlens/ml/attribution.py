"""How much each feature moved a boosted score, per row and overall."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.session import shared_dir


def tree_nodes(model: PipelineModel) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """Node arrays per tree, and tree weights.

    Taken from the saved form of the model, whose size is fixed by its number of trees and their depth.
    """
    fitted = model.stages[-1]
    session = SparkSession.getActiveSession()
    folder = f"{shared_dir(session)}/trees-{uuid.uuid4().hex}"
    fitted.save(folder)
    rows = session.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, list] = {}
    for row in rows:
        trees.setdefault(row["treeID"], []).append(row)
    out = []
    for tree in sorted(trees):
        nodes = sorted(trees[tree], key=lambda r: r["id"])
        position = {r["id"]: i for i, r in enumerate(nodes)}
        is_leaf = [r["leftChild"] < 0 for r in nodes]
        out.append({
            "value": np.array([r["prediction"] for r in nodes]),
            "left": np.array([i if leaf else position[r["leftChild"]] for i, (r, leaf) in enumerate(zip(nodes, is_leaf))]),
            "right": np.array([i if leaf else position[r["rightChild"]] for i, (r, leaf) in enumerate(zip(nodes, is_leaf))]),
            "feature": np.array([-1 if leaf else r["split"]["featureIndex"] for r, leaf in zip(nodes, is_leaf)]),
            "cut": np.array([0.0 if leaf else r["split"]["leftCategoriesOrThreshold"][0] for r, leaf in zip(nodes, is_leaf)]),
        })
    return out, np.array(fitted.treeWeights)


def path_contributions(x: np.ndarray, trees: Sequence[dict[str, np.ndarray]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Base value and contributions: along each decision path, a step's change of the node mean goes to its feature."""
    base = float(sum(w * t["value"][0] for t, w in zip(trees, weights)))
    moved = np.zeros_like(x)
    rows = np.arange(len(x))
    for tree, weight in zip(trees, weights):
        at = np.zeros(len(x), dtype=int)
        while True:
            feature = tree["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            here, which = rows[inner], feature[inner]
            goes_left = x[here, which] <= tree["cut"][at[inner]]
            then = np.where(goes_left, tree["left"][at[inner]], tree["right"][at[inner]])
            moved[here, which] += weight * (tree["value"][then] - tree["value"][at[inner]])
            at[inner] = then
    return base, moved


def local_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per row: base value, contribution per feature (array in feature order) and the margin they add up to."""
    trees, weights = tree_nodes(model)
    shipped = df.sparkSession.sparkContext.broadcast((trees, weights))
    names, ids = list(features), list(keys)
    rows = df.select(*ids, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
    schema = T.StructType([*[df.schema[k] for k in ids], *[T.StructField(f, T.DoubleType()) for f in names],
                           T.StructField("base_value", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType()))])

    def explain(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        own_trees, own_weights = shipped.value
        for batch in batches:
            base, moved = path_contributions(batch[names].to_numpy(dtype=float), own_trees, own_weights)
            yield batch.assign(base_value=base, contributions=list(moved))

    out = rows.mapInPandas(explain, schema)
    return out.withColumn("margin", F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v))


def local_factors(contributions: DataFrame, features: Sequence[str], keys: Sequence[str], top_n: int = 25,
                  epsilon: float = 1e-6, binary: Iterable[str] = ()) -> DataFrame:
    """The strongest increasing and decreasing features per row.

    Contributions below ``epsilon`` are left out; a binary feature counts only where it is 1.
    """
    yes_no = set(binary)
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.when(F.col(f) == 1, F.col("contributions")[i]).otherwise(0.0) if f in yes_no else F.col("contributions")[i]).alias("contribution"))
        for i, f in enumerate(features)])

    def strongest(sign: int):
        kept = F.filter(pairs, lambda p: (p["contribution"] * sign >= epsilon) & (p["contribution"] * sign > 0))
        ordered = F.array_sort(F.transform(kept, lambda p: F.struct((-sign * p["contribution"]).alias("k"), p["feature"].alias("f"))))
        return F.slice(F.transform(ordered, lambda p: F.struct(p["f"].alias("feature"), (-sign * p["k"]).alias("contribution"))), 1, top_n)

    return contributions.select(*keys, "base_value", strongest(1).alias("increasing_factors"), strongest(-1).alias("decreasing_factors"), "margin")


def key_drivers(contributions: DataFrame, features: Sequence[str], keys: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` features that moved a row's score most in either direction, strongest first."""
    pairs = F.array(*[
        F.struct((-F.abs(F.col("contributions")[i])).alias("k"), F.lit(f).alias("feature"), F.col("contributions")[i].alias("contribution"))
        for i, f in enumerate(features)])
    top = F.slice(F.array_sort(pairs), 1, n)
    return contributions.select(*keys, F.transform(top, lambda p: F.struct(p["feature"], p["contribution"])).alias("key_drivers"))


def global_factors(contributions: DataFrame, features: Sequence[str], top_n: int = 25, epsilon: float = 1e-6) -> DataFrame:
    """Mean absolute contribution per feature, ranked. The aggregate has one row, the result one per feature."""
    wide = contributions.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f) for i, f in enumerate(features)])
    long = wide.unpivot([], list(features), "feature", "mean_abs_contribution").where(F.col("mean_abs_contribution") >= epsilon)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mean_abs_contribution")).alias("k"), F.col("feature").alias("f")))), 1, top_n)
    ranked = long.agg(top.alias("t")).select(F.posexplode("t").alias("i", "r"))
    return ranked.select(F.col("r.f").alias("feature"), (-F.col("r.k")).alias("mean_abs_contribution"), (F.col("i") + 1).alias("rank"))


def background_sample(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """A share of the rows, by the leading 32 bits of a seeded hash: the same rows on every run, all of them at share 1."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < F.lit(round(share * 2**32)))
