import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.ml import attribution as at
from memberlens.ml import evaluate as ev
from memberlens.ml import oversample as ov
from memberlens.ml import train as tr
from tests.helpers import rows, table


def pairs_auc(data):
    pos, neg = [s for s, y in data if y == 1], [s for s, y in data if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def step_ap(data):
    total, hit, seen, out, last = sum(y for _, y in data), 0, 0, 0.0, 0
    for s in sorted({s for s, _ in data}, reverse=True):
        hit += sum(1 for t, y in data if t == s and y == 1)
        seen += sum(1 for t, _ in data if t == s)
        out += (hit - last) / total * hit / seen
        last = hit
    return out


@pytest.mark.parametrize("levels,buckets", [(5, 1), (40, 6), (2, 4)])
def test_metrics_equal_pairwise_definitions(spark, levels, buckets):
    rng = random.Random(levels)
    data = [(rng.randrange(levels) / levels, int(rng.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame([*data, (None, 1), (0.5, None)], "s double, y int")
    m = ev.classification_metrics(df, "y", "s", buckets=buckets).first()
    assert math.isclose(m["roc_auc"], pairs_auc(data), rel_tol=1e-12) and math.isclose(m["pr_auc"], step_ap(data), rel_tol=1e-12)
    tp = sum(1 for s, y in data if s >= 0.5 and y)
    assert (m["tp"], m["tp"] + m["fn"], m["tp"] + m["fp"]) == (tp, sum(y for _, y in data), sum(1 for s, _ in data if s >= 0.5))


def test_metrics_of_one_class_are_null(spark):
    m = ev.classification_metrics(spark.createDataFrame([(0.3, 1), (0.9, 1)], "s double, y int"), "y", "s").first()
    assert m["roc_auc"] is None and m["pseudo_r2"] is None and m["recall"] == 0.5


def test_equal_scores(spark):
    m = ev.classification_metrics(spark.createDataFrame([(0.3, 1), (0.3, 0)], "s double, y int"), "y", "s").first()
    assert m["roc_auc"] == 0.5 and m["pr_auc"] == 0.5


def test_pr_table_and_best(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    got = table(ev.pr_table(df, "y", "s", buckets=2), "threshold", "tp", "fp", "precision", "recall")
    assert got == {0.9: (1, 0, 1.0, 0.5), 0.8: (1, 1, 0.5, 0.5), 0.7: (2, 2, 0.5, 1.0), 0.1: (2, 3, 0.4, 1.0)}
    assert ev.best_threshold(df, "y", "s").first()["threshold"] == 0.7
    assert table(ev.pr_at(df, "y", "s", [0.8, 0.95]), "threshold", "precision", "recall") == {0.8: (0.5, 0.5), 0.95: (None, 0.0)}


def test_calibration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1), (0.5, 0.25, 0), (1.0, 0.75, 1), (0.51, None, 1)], "a double, b double, y int")
    got = table(ev.calibration_table(df, "y", ["a", "b"], 2), ["model", "bin"], "count", "actual_events", "predicted_events")
    assert got == {("a", 0): (2, 1, 0.5), ("a", 1): (2, 2, 1.51), ("b", 0): (1, 0, 0.25), ("b", 1): (2, 2, 1.75)}


def test_reports_and_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    got = table(ev.class_report(df, "y", "p"), "class", "precision", "recall", "support")
    assert got == {0: (2 / 3, 1.0, 2), 1: (1.0, 0.5, 2)}
    s = spark.createDataFrame([(0.3, 0.3), (0.4, 0.4), (0.39, 0.9), (0.9, 0.9)], "a double, b double")
    picked = s.select(ev.consensus(F.col("a"), F.col("b")), ev.consensus_by_band(F.col("a"), F.col("b")), ev.risk_class(F.col("a")))
    assert [tuple(r) for r in picked.collect()] == [("LOW", "low_risk", "low"), ("HIGH", "medium_risk", "low"), ("MEDIUM", "medium_risk", "low"), ("HIGH", "high_risk", "high")]


def brute_neighbours(vectors, k):
    out = {}
    for i, v in vectors.items():
        near = sorted((math.dist(v, w), j) for j, w in vectors.items() if j != i)[:k]
        out[i] = [round(x, 9) for x, _ in near]
    return out


@pytest.mark.parametrize("pivots,block_rows", [(16, 2000), (8, 7), (3, 10)])
def test_neighbours_are_exact(spark, pivots, block_rows):
    rng = random.Random(pivots)
    centres = [[rng.uniform(-5, 5) for _ in range(4)] for _ in range(3)]
    vectors = {i: [c + rng.gauss(0, 0.3) for c in centres[i % 3]] for i in range(90)}
    df = spark.createDataFrame(list(vectors.items()), "id long, vec array<double>")
    got = {}
    for r in ov.nearest_neighbours(df, 5, pivots, block_rows).orderBy("rep", "lo").collect():
        got.setdefault(r["rep"], []).append(round(r["distance"], 9))
    assert got == brute_neighbours(vectors, 5)


def test_copies_are_their_own_neighbours(spark):
    points = [(i, [0.0, 0.0]) for i in range(40)] + [(100, [1.0, 0.0]), (101, [2.0, 0.0]), (102, [2.0, 0.0])]
    got = ov.nearest_neighbours(spark.createDataFrame(points, "id long, vec array<double>"), 5).collect()
    zero = [r for r in got if r["rep"] == 0]
    assert [(r["lo"], r["distance"]) for r in zero] == [(1, 0.0)] and zero[0]["hi"] == 39
    pair = sorted((r["lo"], r["hi"], r["distance"]) for r in got if r["rep"] == 101)
    assert pair[:2] == [(1, 1, 0.0), (2, 2, 1.0)] and pair[2][2] == 2.0


def test_oversampling_balances_between_neighbours(spark):
    rng = random.Random(3)
    data = [(i, [rng.random(), rng.random()], int(i < 10)) for i in range(57)]
    out = ov.oversampled(spark.createDataFrame(data, "id long, vec array<double>, label int"))
    assert table(out.groupBy("label").count(), "label", "count") == {0: 47, 1: 47}
    box = np.array([v for i, v, y in data if y])
    made = np.array([r["vec"] for r in out.where("synthetic").collect()])
    assert (made >= box.min(axis=0) - 1e-12).all() and (made <= box.max(axis=0) + 1e-12).all()
    assert sorted(map(tuple, made.tolist())) == sorted(map(tuple, (r["vec"] for r in ov.oversampled(
        spark.createDataFrame(data, "id long, vec array<double>, label int")).where("synthetic").collect())))


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(9)
    data = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        data.append((i, a, b, float(rng.random() < 0.5), int(a + 0.3 * b > 0.7)))
    df = spark.createDataFrame(data, "member_id long, a double, b double, flag double, y int").repartition(2).persist()
    return df, ["a", "b", "flag"]


def test_logistic_learns_and_scores(spark, learnt):
    df, features = learnt
    model = tr.train_logistic(df, features, "y")
    scored = tr.score(model, df, features)
    assert ev.classification_metrics(scored, "y", "score").first()["roc_auc"] > 0.97
    weights, intercept = tr.logistic_weights(model, features)
    _, total = ev.score_buildup(weights, intercept)
    gap = scored.select(F.abs(1 / (1 + F.exp(-total)) - F.col("score")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-9 and weights["a"] > abs(weights["flag"])
    assert rows(tr.ranked_weights(spark, weights), "rank")[0] == (1,)


def test_boosted_contributions_add_up(spark, learnt):
    df, features = learnt
    model = tr.train_boosted(df, features, "y", maxIter=4, maxDepth=3)
    scored = tr.score(model, df, features)
    local = at.local_contributions(model, df, features, ["member_id"])
    joined = local.join(scored.select("member_id", "score"), "member_id")
    gap = joined.select(F.abs(1 / (1 + F.exp(-2 * F.col("margin"))) - F.col("score")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-6
    top = at.local_factors(local, features, ["member_id"], top_n=1, binary=["flag"])
    assert top.where(F.size("increasing_factors") > 1).count() == 0
    drivers = at.key_drivers(local, features, ["member_id"], 2).first()["key_drivers"]
    assert len(drivers) == 2 and abs(drivers[0]["contribution"]) >= abs(drivers[1]["contribution"])
    ranked = at.global_factors(local, features)
    assert ranked.orderBy("rank").first()["feature"] == "a"
    assert tr.importances(model, features)["a"] > 0.5


def test_search_and_calibration(spark, learnt):
    df, features = learnt
    grid = tr.param_grid({"maxDepth": [1, 2], "maxIter": [2]})
    assert len(grid) == 2 and tr.random_params(tr.BOOSTED_DRAWS, 3) == tr.random_params(tr.BOOSTED_DRAWS, 3)
    found = tr.search_boosted(df, features, "y", grid, folds=2)
    assert tr.search_table(spark, found, grid).count() == 2
    model = tr.calibrate(df, "y", "a")
    out = [r["calibrated"] for r in tr.apply_calibration(model, df, "a").orderBy("a").collect()]
    assert out == sorted(out) and 0 <= out[0] <= out[-1] <= 1


def test_small_training_helpers(spark, learnt):
    df, features = learnt
    assert {r["label"]: r["n"] for r in tr.class_counts(df, "y").collect()} == {c: df.where(f"y = {c}").count() for c in (0, 1)}
    holes = spark.createDataFrame([(1.0, None), (3.0, 4.0)], "a double, b double")
    assert rows(tr.filled(holes, ["a", "b"]), "b") == [(0.0,), (4.0,)] and rows(tr.filled(holes, ["a", "b"], "mean"), "b") == [(4.0,), (4.0,)]
    assert tr.ablations(["a", "b", "c"], {"g": ["A"], "h": ["b"]}) == {"horizon_0": ["c"], "horizon_1": ["a", "c"], "horizon_2": ["a", "b", "c"]}
    assert at.background_sample(df, 1.0, "member_id").count() == df.count() and 0 < at.background_sample(df, 0.5, "member_id").count() < df.count()


def test_consolidated_individuals_keep_months_apart(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "train", 1, 0.9, 0.2), (1, "2024-02-01", "train", 0, 0.6, 0.3), (1, "2022-02-01", "train", 0, 0.6, 0.3)],
                               "member_id long, month string, split string, y int, lr double, gb double").withColumn("month", F.col("month").cast("date"))
    factors = df.select("member_id", "month", F.lit(0.5).alias("base_value"), F.col("gb").alias("margin"))
    got = rows(ev.consolidated_individuals(df, "y", "lr", "gb", ev.score_buildup({"lr": 2.0}, 1.0), "2023-01-01", boosted=factors),
               "risk_class", "logistic_total_score", "boosted_score_build")
    assert got == [("high", 2.8, '{"base_value":0.5,"margin":0.2}'), ("medium", 2.2, '{"base_value":0.5,"margin":0.3}')]


def test_recent_windows(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-03-01"), (2, "2024-02-01")], "member_id long, month string").withColumn("month", F.col("month").cast("date"))
    assert [r["member_id"] for r in ev.recent_report(df, "2024-02-01", "2024-12-01").collect()] == [1, 2]
    scored = df.withColumn("a", F.lit(0.5)).withColumn("b", F.lit(0.1))
    assert {r["risk_classification"] for r in ev.recent_consensus(scored, "a", "b", k=1).collect()} == {"MEDIUM"}
    assert ev.class_summary(scored.withColumn("y", F.lit(1)), ["member_id"], "a", "y").where("member_id = 1").first()[1:] == (2, 1.0, 0.5, 2)


@pytest.mark.parametrize("n,dims,tables,reach,block", [(60, 2, 4, 9, 16), (300, 5, 6, 12, 50), (5, 3, 2, 64, 4096), (2, 3, 2, 4, 8)])
def test_bucket_neighbours_rank_the_visited_exactly(spark, n, dims, tables, reach, block):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 1, (n, dims)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n + 5, x[0].tolist())], "id long, vec array<double>").repartition(3)
    got = {}
    for r in ov.bucket_neighbours(df, 5, tables, 6, reach, block).collect():
        got.setdefault(r["rep"], []).append((r["lo"], r["hi"], r["neighbour"]))
    g = np.floor(np.unique(x, axis=0) * ov.GRID)
    first = {tuple(v): i for i, v in reversed(list(enumerate(x.tolist())))}
    reps = np.array([first[tuple(v)] for v in np.unique(x, axis=0).tolist()])
    planes = ov.signs(tables, 6, dims)
    seen = {int(r): set() for r in reps}
    for t in range(tables):
        code = ((g - np.floor(g.mean(0))) @ planes[t].T >= 0) @ (2 ** np.arange(6)[::-1])
        order = sorted(range(len(reps)), key=lambda i: (code[i], reps[i]))
        for a in range(len(order)):
            for b in range(max(0, a - reach), min(len(order), a + reach + 1)):
                if a != b:
                    seen[int(reps[order[a]])].add(order[b])
    at = {int(r): i for i, r in enumerate(reps)}
    for rep, others in seen.items():
        near = sorted(others, key=lambda j: (((g[at[rep]] - g[j]) ** 2).sum(), reps[j]))[:5]
        want, place = ([(1, 1, rep)], 1) if rep == 0 else ([], 0)
        for j in near:
            many = 2 if reps[j] == 0 else 1
            want.append((place + 1, place + many, int(reps[j])))
            place += many
        assert sorted(got[rep]) == [w for w in want if w[0] <= 5]


def test_bucket_neighbours_find_most_of_the_nearest(spark, small_data):
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("vec_id < 2500")
    x = np.floor(np.array([r["vec"] for r in points.orderBy("id").collect()], float) * ov.GRID)
    got = {}
    for r in ov.bucket_neighbours(points).where("rep % 25 = 0").collect():
        got.setdefault(r["rep"], set()).add(r["neighbour"])
    hits = total = 0
    for rep, found in got.items():
        d = ((x - x[rep]) ** 2).sum(1)
        d[rep] = np.inf
        best = set(np.argsort(d, kind="stable")[:5].tolist())
        hits, total = hits + len(best & found), total + 5
    assert total >= 400 and hits / total >= 0.9
