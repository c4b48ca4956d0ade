import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memberlens.llm import negatives
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, asked, positives=5, wanted=3, scale=256):
    """{(anchor, positive, rank, negative, positive score, negative score)} for distinct ids."""
    good = {(i, tuple(v), x) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    whole = [(i, [int(np.floor(c * scale)) for c in v], x) for i, v, x in good]
    out = set()
    for a, q, label in whole:
        if not asked(a):
            continue
        scored = sorted(((-sum(s * t for s, t in zip(q, v)), i, x) for i, v, x in whole if len(v) == len(q)))
        near = [(-s, i) for s, i, x in scored if x == label and i != a][:positives]
        for p, i in near:
            far = [(-s, j) for s, j, x in scored if x != label and 50 * p <= 100 * -s <= 95 * p][:wanted]
            out |= {(a, i, r, j, p, s) for r, (s, j) in enumerate(far, 1)}
    return out


def got(df):
    rows = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(n=260, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, list(map(float, np.round(rng.normal(0.4, 0.5, dim), 2))), "abc"[i % 3] if i % 4 else "hot") for i in range(n)]
    rows += [(n, [0.25] * dim, "a"), (n + 1, [0.25] * dim, "b"), (n + 2, [0.25] * dim, "b"), (n + 3, [0.25] * dim, "b"), (n + 4, [0.0] * dim, "a"),
             (n + 5, [1.0, 2.0], "a"), (n + 6, [1.0, 1.5], "a"), (n + 7, [1.0, 1.0], "b"), (n + 8, [], "a"), (n + 9, [], "b"), (n + 10, [], "a"), (n + 11, [0.3] * dim, "alone")]
    return rows


def awkward():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * 6, "a"), (900, None, "a"), (901, [1.0, None, 1.0, 1.0], "a"), (902, [nan] * 6, "a"), (903, [inf] + [0.0] * 5, "b"), (904, [1.0] * 6, None),
            (3, [0.9] * 6, "a"), (3, [0.9] * 6, "a")]


@pytest.mark.parametrize("shard_rows,block,step", [(4096, 4096, 16), (17, 9, 1), (40, 50, 3)])
def test_equals_plain_search(spark, shard_rows, block, step):
    rows = [r for r in vectors() if r[0] != 3] + awkward()
    df = brute.clashing(spark.createDataFrame(rows, SCHEMA))
    found = negatives.hard_negatives(df, F.col("id") % 5 == 0, shard_rows=shard_rows, block_anchors=block, step=step)
    want = plain(rows, lambda i: i % 5 == 0)
    assert got(found) == want and len(want) > 100


def test_large_components_are_exact(spark):
    rows = [(i, [3e6 + i, 3.0, -3e6 + 2 * i], "ab"[i % 2]) for i in range(40)] + [(99, [3e12, 1.0, 0.0], "a"), (98, [1.0, 2e9, 1.0], "b")]
    found = negatives.hard_negatives(spark.createDataFrame([r for r in rows if r[0] < 90], SCHEMA), F.col("id") % 3 == 0)
    assert got(found) == plain([r for r in rows if r[0] < 90], lambda i: i % 3 == 0)
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame(rows + [(97, [3e12, 1.0, 0.0], "a")], SCHEMA), F.col("id") == 99).collect()


def test_empty_tables_and_lone_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "b")], SCHEMA)
    assert negatives.hard_negatives(lone, F.col("id") == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0], "a") for i in range(9)], SCHEMA)
    assert negatives.hard_negatives(same, F.col("id") == 0).count() == 0


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_threshold_search_equals_sorting(data):
    dim, n = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 40))
    cell = st.integers(-3, 3).map(float)
    points = np.array(data.draw(st.lists(st.lists(cell, min_size=dim, max_size=dim), min_size=n, max_size=n)))
    query = np.array(data.draw(st.lists(cell, min_size=dim, max_size=dim)))
    allowed = np.array(data.draw(st.lists(st.booleans(), min_size=n, max_size=n)))
    ids = np.array(data.draw(st.permutations(range(n))))
    low, high = sorted((data.draw(st.integers(-20, 20)), data.draw(st.integers(-20, 20))))
    windows, best = [(float("-inf"), float("inf")), (low, high)], [[], []]
    negatives.Shard.of(dim, ids, ["x"] * n, points, scale=1).search(query, allowed, windows, best, 3, step=1)
    scores = [(int(points[i] @ query), -int(ids[i])) for i in range(n) if allowed[i]]
    assert best == [sorted((s for s in scores if a <= s[0] <= b), reverse=True)[:3] for a, b in windows]


def test_search_stops_early():
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (4000, 2)) ** 3
    shard, best = negatives.Shard.of(2, np.arange(4000), ["x"] * 4000, points), [[]]
    assert shard.search(np.array([1.0, 0.5]), np.ones(4000, bool), [(float("-inf"), float("inf"))], best, 3) < 400
