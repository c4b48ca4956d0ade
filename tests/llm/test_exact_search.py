import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memberlens.llm import exact, kdsearch

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, asked, k=10, scale=1024):
    """[(query, rank, id, score)] in Python's whole numbers."""
    whole = sorted({(i, tuple(math.floor(x * scale) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, own in whole:
        if asked(q):
            found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == len(own))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_rows,block", [(4096, 4096), (7, 5)])
def test_large_components_and_other_lengths_stay(spark, shard_rows, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 3).round(2).tolist()) for i in range(60)]
    rows += [(60, [1e13, 0.0, 0.0]), (61, [-1e13, 5.0, 1.0]), (62, [2e5, 2e5, 2e5]), (63, [-2e5, 1.0, 2.0]), (-1, [7.0]), (-2, [1.0]), (70, []), (71, []), (72, [3.0]),
             (80, rng.normal(0, 1, 5).tolist()), (81, rng.normal(0, 1, 5).tolist()), (82, [1.0, 2.0, None]), (None, [1.0, 2.0, 3.0]), (83, None), (84, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    small = [r for r in rows if r[0] not in (60, 61)]
    asked = F.col("id") % 5 == 0
    assert got(kdsearch.top_k(df.where("vec_id not in (60, 61)"), asked, shard_rows=shard_rows, block_queries=block)) == plain(small, lambda i: i % 5 == 0)
    # scores with a component of 1e12 fit 64 bits beside small vectors
    few = rows[:60] + [(60, [1e12, 0.0, 0.0])]
    assert got(kdsearch.top_k(spark.createDataFrame(few, SCHEMA), F.col("id").isin(3, 60), k=4, shard_rows=shard_rows)) == plain(few, lambda i: i in (3, 60), 4)


def test_a_score_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e13]), (1, [1e13])], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        kdsearch.top_k(df, F.col("id") == 0).collect()


def test_several_vectors_of_one_id_are_several_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0])], SCHEMA)
    found = got(kdsearch.top_k(df, F.col("id") == 0, k=1, scale=1))
    assert found == [(0, 1, 1, 2), (0, 1, 2, 2)]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_tree_search_equals_sorting(data):
    dim, n = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 50))
    size = data.draw(st.sampled_from([3, 2**27, 2**40]))
    cell = st.integers(-size, size).map(float)
    points = np.array(data.draw(st.lists(st.lists(cell, min_size=dim, max_size=dim), min_size=n, max_size=n)))
    query = np.array(data.draw(st.lists(cell, min_size=dim, max_size=dim)))
    tree = kdsearch.Tree(points, np.arange(n), leaf=4)
    want = sorted(((sum(int(a) * int(b) for a, b in zip(p, query)), -i) for i, p in enumerate(points) if i != 1), reverse=True)[:3]
    assert sorted(tree.search(query, 1, 3, float("-inf")), reverse=True) == want


def test_whole_numbers():
    assert exact.exact(np.array([0.5, -0.3, 1e300, 1e308]), 1024).tolist() == [512, -308, int(1e300 * 1024), int(1e308) * 1024]
    assert exact.fits(2.0**20, np.array([2.0**30])) and not exact.fits(2.0**30, np.array([2.0**30])) and len(exact.padded([])) == 1
