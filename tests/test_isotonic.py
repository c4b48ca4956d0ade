import random

import pytest

from memberlens.ml import isotonic as iso

from tests.helpers import table


def plain(data):
    """{score: value} by pooling one list."""
    counts = {}
    for s, y in data:
        if s is not None and y is not None:
            a, b = counts.get(s, (0, 0))
            counts[s] = a + y, b + 1
    out = {}
    for lo, hi, y, n in iso.pooled([(s, s, y, n) for s, (y, n) in sorted(counts.items())]):
        out |= {s: y / n for s in counts if lo <= s <= hi}
    return out


def minmax(data):
    """The definition: largest over starts of the smallest mean over ends."""
    scores = sorted({s for s, _ in data})
    means = {}
    for i, a in enumerate(scores):
        for b in scores[i:]:
            rows = [y for s, y in data if a <= s <= b]
            means[a, b] = sum(rows) / len(rows)
    return {s: max(min(means[a, b] for b in scores if b >= s) for a in scores if a <= s) for s in scores}


def test_pooling_is_the_definition():
    r = random.Random(1)
    data = [(r.randrange(12) / 4, r.randrange(2)) for _ in range(60)]
    got, want = plain(data), minmax(data)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in want)


SHAPES = {"rising": lambda s, r: int(r.random() < s), "falling": lambda s, r: int(r.random() > s), "noise": lambda s, r: r.randrange(2),
          "steps": lambda s, r: int(s * 10) % 2, "all": lambda s, r: 1, "cliff": lambda s, r: int(s < 0.05)}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("look", [1, 3, 1024])
def test_ranges_merged_over_a_tree_equal_one_list(spark, shape, look):
    r = random.Random(shape)
    scores = [r.random() for _ in range(400)] + [0.5] * 30
    data = [(s, SHAPES[shape](s, r)) for s in scores] + [(None, 1), (0.3, None)]
    df = spark.createDataFrame(data, "s double, y int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        blocks = iso.fit(df, "y", "s", look)
        got = table(iso.apply(blocks, df.select("s").distinct(), "s"), "s", "calibrated")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(data)
    assert got.pop(None) is None and got == pytest.approx({**want, 0.3: got[0.3]})


def test_scores_between_and_beyond_the_blocks(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (5.0, 1)], "s double, y int")
    blocks = iso.fit(df, "y", "s")
    asked = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 3.5, 4.0, 9.0)], "s double")
    assert table(iso.apply(blocks, asked, "s"), "s", "calibrated") == {0.0: 0.0, 1.0: 0.0, 1.5: 0.0, 2.0: 0.0, 3.0: 0.5, 3.5: 0.75, 4.0: 1.0, 9.0: 1.0}


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "s double, y int")
    blocks = iso.fit(empty, "y", "s")
    assert blocks.count() == 0
    assert table(iso.apply(blocks, spark.createDataFrame([(1.0,)], "s double"), "s"), "s", "calibrated") == {1.0: None}


def test_no_window_reaches_the_end_of_its_group(spark):
    """Such a frame starts anew for every row, so one range of many scores took quadratic time."""
    df = spark.createDataFrame([(i / 10, i % 2) for i in range(50)], "s double, y int")
    out = iso.apply(iso.fit(df, "y", "s"), df.select("s").distinct(), "s")
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert out.count() == 50
