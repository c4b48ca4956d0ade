import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.llm import kdsearch, sharding
from tests.llm import brute


def test_table_is_filled_in_turns():
    shards, size = ["a", "b", "c"], 13
    owner, orders = [None] * size, {s: [(start + i * step) % size for i in range(size)] for s in shards for start, step in [sharding.preference(s, size)]}
    turn = 0
    while None in owner:
        s = shards[turn % 3]
        owner[next(x for x in orders[s] if owner[x] is None)] = s
        turn += 1
    assert [shards[i] for i in sharding.fill_table(shards, size)] == owner


def test_shares_are_even_and_moves_are_few():
    shards = [f"s{i}" for i in range(20)]
    shares = collections.Counter(sharding.fill_table(shards, 5003)).values()
    assert max(shares) - min(shares) <= 1
    assert sharding.moved_share(shards, shards[:-1], 5003) < 0.15


def test_bad_tables():
    for shards, size in (([], 13), (["a", "a"], 13), (["a"], 12)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_place_agrees_with_plain_lookup(spark):
    import hashlib

    shards, size = ["x", "y", "z"], 101
    owner = sharding.fill_table(shards, size)
    rows = [(1,), (1,), (None,), (77,), (-5,)]
    df = brute.clashing(spark.createDataFrame(rows, "doc_id long"))
    got = sorted((str(r["key"]), r["slot"], r["shard"]) for r in sharding.place(df, "doc_id", shards, size).collect())
    slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % size
    assert got == sorted((str(k), slot(k), shards[owner[slot(k)]]) for k, in rows)
    assert sharding.place(df.where("false"), "doc_id", shards, size).count() == 0


def test_placement_stays_native(spark):
    plan = sharding.place(spark.range(10), "id", ["x", "y"], 101)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def vectors(seed, n, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # equal vectors
    return rows + [(n + 50, None), (n + 51, []), (n + 52, [None] * dim), (n + 53, [float("nan")] * dim), (n + 54, [float("inf")] + [0.0] * (dim - 1))]


@pytest.mark.parametrize("shard_rows,block", [(10_000, 4096), (40, 7)])
def test_search_equals_brute_force(spark, shard_rows, block):
    rows = vectors(3, 250)
    df = brute.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = kdsearch.top_k(df, F.col("id") % 20 == 0, shard_rows=shard_rows, block_queries=block).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], -r["vec_id"]))
    want = brute.top_k([(i, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, v in rows], lambda q: q % 20 == 0)
    assert got == want


def test_few_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in kdsearch.top_k(df, F.col("id") == 0).collect()] == [(0, 1, 1, 512 * 1024)]
    assert kdsearch.top_k(df.where("false"), F.col("id") == 0).count() == 0


def test_boxes_bound_their_vectors_and_cut_the_walk():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (20, 3))
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 5, (2000, 3)))
    tree = kdsearch.Tree(points, np.arange(2000), leaf=16)
    query = np.array([3.0, -1.0, 2.0])
    bound = tree.bounds(query)
    for a, b, most in zip(tree.starts, tree.ends, bound):
        assert (tree.points[a:b] @ query).max() <= most
    best = sorted(tree.search(query, -1, 5, -np.inf), reverse=True)
    assert best == sorted(((float(s), -i) for i, s in enumerate(points @ query)), reverse=True)[:5]
    assert tree.search(query, -1, 5, float((points @ query).max()) + 1) == []
