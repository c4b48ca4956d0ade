"""Isotonic calibration over every distinct score, by pooling ranges and merging them over a tree.

Scores are counted first, so a score that many rows share is one row. Ranges of the score pool their own violators; then
neighbouring ranges are joined in pairs, level by level. Two rising sequences of blocks can only pool at their seam, and only
into one block, so a join looks at the last blocks of the left side and the first of the right one; where those are used up
it looks again. Neither the driver nor a task ever holds all blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.operators.ordering import in_ranges
from memberlens.sources.tables import stored

#: Blocks on each side of a seam that are looked at together.
SEAM = 1_024

BLOCK = "part int, lo double, hi double, y long, n long"
NAMES = ["part", "lo", "hi", "y", "n"]


def pooled(blocks: list[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Rising means from (lo, hi, y, n) in order: a block whose mean is not above the one before joins it."""
    out: list[tuple[float, float, int, int]] = []
    for lo, hi, y, n in blocks:
        while out and out[-1][2] * n >= y * out[-1][3]:
            lo, _, before, rows = out.pop()
            y, n = y + before, n + rows
        out.append((lo, hi, y, n))
    return out


def seam(left: list[tuple], right: list[tuple]) -> tuple[tuple, int, int] | None:
    """The block that pools at a seam, and how many blocks of each side went into it; None where the means rise."""
    if not left or not right or left[-1][2] * right[0][3] < right[0][2] * left[-1][3]:
        return None
    lo, hi, y, n = left[-1][0], right[0][1], left[-1][2] + right[0][2], left[-1][3] + right[0][3]
    a = b = 1
    while True:
        if a < len(left) and left[-a - 1][2] * n >= y * left[-a - 1][3]:
            lo, y, n, a = left[-a - 1][0], y + left[-a - 1][2], n + left[-a - 1][3], a + 1
        elif b < len(right) and y * right[b][3] >= right[b][2] * n:
            hi, y, n, b = right[b][1], y + right[b][2], n + right[b][3], b + 1
        else:
            return (lo, hi, y, n), a, b


def fit(df: DataFrame, label: str, score: str, look: int = SEAM) -> DataFrame:
    """Stored blocks (lo, hi, y, n, value) of rising value; rows without label or score are left out. Labels are whole numbers."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(
        F.sum(F.col(label).cast("bigint")).alias("y"), F.count("*").alias("n"))
    ranges = in_ranges(counts, ["lo"], "score-ranges")

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lo")
        part = int(frame["part"].iloc[0])
        found = pooled([(s, s, int(y), int(n)) for s, y, n in zip(frame["lo"], frame["y"], frame["n"])])
        return pd.DataFrame([(part, *b) for b in found], columns=NAMES)

    blocks = stored(ranges.select("part", "lo", "y", "n").groupBy("part").applyInPandas(own, BLOCK), "isotonic-ranges")
    level, last = 0, blocks.agg(F.max("part")).first()[0] or 0
    while last >> level:
        level += 1
        pair, is_left = F.shiftright("part", level).alias("pair"), F.shiftright("part", level - 1).bitwiseAND(1) == 0
        join = joined(level, look)
        while True:
            sides = blocks.select("*", pair, is_left.alias("left"))
            near = Window.partitionBy("pair", "left").orderBy(F.when(F.col("left"), -F.col("lo")).otherwise(F.col("lo")))
            edges = sides.withColumn("i", F.row_number().over(near)).where(F.col("i") <= look).drop("i")
            made = stored(edges.groupBy("pair").applyInPandas(join, f"{BLOCK}, again boolean"), "isotonic-seams")
            gone = made.select(F.shiftright("part", level).alias("pair"), F.col("lo").alias("from"), F.col("hi").alias("to"))
            kept = sides.join(gone, "pair", "left").where(F.col("from").isNull() | (F.col("lo") < F.col("from")) | (F.col("lo") > F.col("to")))
            blocks = stored(kept.select(NAMES).unionByName(made.select(NAMES)), "isotonic-blocks")
            if made.where("again").isEmpty():
                break
    return blocks.select("lo", "hi", "y", "n", (F.col("y") / F.col("n")).alias("value"))


def joined(level: int, look: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lo")
        sides = [[(a, b, int(y), int(n)) for a, b, y, n in zip(f["lo"], f["hi"], f["y"], f["n"])] for f in (frame[frame["left"]], frame[~frame["left"]])]
        found = seam(*sides)
        if found is None:
            return pd.DataFrame(columns=[*NAMES, "again"])
        block, a, b = found
        # the new block is the last one of the left side
        part = (int(frame["part"].iloc[0]) >> level << level) + (1 << level - 1) - 1
        return pd.DataFrame([(part, *block, a == look or b == look)], columns=[*NAMES, "again"])

    return run


def apply(blocks: DataFrame, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """``df`` with the value of each score: that of its block, between two blocks on the line from one to the other, beyond the
    ends that of the first or last block; null for a null score.

    Scores and block ends are put in one order; a range hands its last end on to the next ones and its first to those before.
    """
    asked = df.select(F.col(score).cast("double").alias("s")).where("s is not null").distinct()
    ends = blocks.select(F.explode(F.array("lo", "hi")).alias("s"), "value").distinct()
    marks = asked.withColumn("value", F.lit(None).cast("double")).unionByName(ends)
    # an end comes before a score that equals it
    rows = in_ranges(marks, ["s", F.col("value").isNull(), "value"], "scores-and-ends")
    end = F.when(F.col("value").isNotNull(), F.struct("s", "value"))
    parts = rows.groupBy("part").agg(F.max(end).alias("last"), F.min(end).alias("first"))
    # both directions look back from the current row: a frame that reaches the end of its group is summed anew for every row
    by_part, from_end = Window.orderBy("part"), Window.orderBy(F.desc("part"))  # a row per range
    handed = parts.select("part", F.last("last", True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                          F.last("first", True).over(from_end.rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    inside, back = Window.partitionBy("part").orderBy("place"), Window.partitionBy("part").orderBy(F.desc("place"))
    seen = rows.join(F.broadcast(handed), "part").select(
        "s", "value", F.coalesce(F.last(end, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "before").alias("below"),
        F.coalesce(F.last(end, True).over(back.rowsBetween(Window.unboundedPreceding, 0)), "after").alias("above"))
    share = (F.col("s") - F.col("below.s")) / (F.col("above.s") - F.col("below.s"))
    value = F.when(F.col("above").isNull() | (F.col("below.s") == F.col("s")), F.col("below.value")).when(
        F.col("below").isNull() | (F.col("below.value") == F.col("above.value")), F.col("above.value")).otherwise(
        F.col("below.value") + share * (F.col("above.value") - F.col("below.value")))
    table = seen.where("value is null").select(F.col("s").alias("_s"), value.alias(name))
    return df.join(table, df[score].cast("double") == table["_s"], "left").drop("_s")


def calibrated(df: DataFrame, train: Column, label: str, score: str, name: str = "calibrated") -> DataFrame:
    """Fit on the rows that meet ``train``, apply to all."""
    return apply(fit(df.where(train), label, score), df, score, name)
