"""Hard negatives by the threshold algorithm over sorted lists per dimension.

For every anchor the best rows of its own label are its positives; for every positive the best rows of other labels whose
score lies in a band below the positive's score are its hard negatives. Scores are inner products of whole numbers,
floor(scale * x), higher ones first, ties by smaller id.

Rows are dealt by label into shards of bounded size. A shard keeps, for each dimension, its rows sorted by that component. A
search reads all lists at once, from the end that raises the score (the sign of the anchor's component says which), scores each
new row in full, and knows from the values it has reached what no unseen row can exceed. It stops once that threshold is
strictly below the kth score of every window asked for (or below the window). Kth scores go from shard to shard of a task.

Anchors are read in blocks of bounded size from a stored table; a block is broadcast for one pass over the shards and given
up afterwards. Every anchor has to meet every shard, so the work grows with anchors times rows; memory does not.

Sums are formed in 64-bit floats where those are exact, else in Python's whole numbers.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; vectors meet those of
their length only; rows that repeat id, label and vector are one row; a positive has another id than its anchor; several rows of
one id are several anchors; a score beyond 64 bits in the result is an error. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import column
from memberlens.llm.exact import exact, fits, floors, padded
from memberlens.llm.order import batch_rows, numbered
from memberlens.sources.tables import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3

#: The band of a negative's score, in hundredths of the positive's.
BAND = (50, 95)

#: Rows in a shard, anchors in a block, rows of each list in the first step of a search, shards in a batch.
SHARD_ROWS = 4_096
BLOCK_ANCHORS = 4_096
STEP = 16
SHARDS_AT_ONCE = 4

SHARD = "shard long, dim int, ids binary, labels array<string>, codes binary, points binary, lists binary"
FOUND = "anchor long, window int, id long, score long"


def usable(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, dim, v): distinct rows that take part; label as a string, v as doubles."""
    rows = df.select(column(key).cast("long").alias("id"), label.cast("string").alias("label"), column(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where("id is not null and label is not null and v is not null").where(finite).select("id", "label", F.size("v").alias("dim"), "v").distinct()


class Shard:
    """Rows with a sorted list per dimension (row numbers by rising component)."""

    def __init__(self, dim: int, ids: np.ndarray, labels: Sequence[str], codes: np.ndarray, points: np.ndarray, lists: np.ndarray, scale: int = SCALE):
        self.dim, self.ids, self.labels, self.codes, self.lists = dim, ids, {x: i for i, x in enumerate(labels)}, codes, lists
        self.points = points
        self.whole = floors(points, scale)
        self.largest = float(np.abs(self.whole).max(initial=0))
        self.scale = scale
        self._exact = None

    @classmethod
    def of(cls, dim, ids, labels, points, scale: int = SCALE) -> "Shard":
        points = np.stack([padded(v) for v in points])
        names, codes = np.unique(np.asarray(labels, object).astype(str), return_inverse=True)
        lists = np.argsort(points, 0, kind="stable").T.astype(np.int32)
        return cls(dim, np.asarray(ids, np.int64), [str(n) for n in names], codes.astype(np.int32), points, lists, scale)

    def packed(self, shard: int) -> tuple:
        arrays = (self.codes, self.points, np.ascontiguousarray(self.lists))
        return shard, self.dim, self.ids.tobytes(), list(self.labels), *(a.tobytes() for a in arrays)

    @classmethod
    def unpacked(cls, row, scale: int) -> "Shard":
        wide = max(row.dim, 1)
        return cls(row.dim, np.frombuffer(row.ids, np.int64), list(row.labels), np.frombuffer(row.codes, np.int32), np.frombuffer(row.points).reshape(-1, wide),
                   np.frombuffer(row.lists, np.int32).reshape(wide, -1), scale)

    def numbers(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and query in numbers whose sums of products are exact."""
        q = floors(query, self.scale)
        if fits(self.largest, q):
            return self.whole, q
        if self._exact is None:
            self._exact = exact(self.points, self.scale)
        return self._exact, exact(query, self.scale)

    def search(self, query: np.ndarray, allowed: np.ndarray, windows: Sequence[tuple], best: list[list[tuple]], k: int, step: int = STEP) -> int:
        """Improve ``best`` (a falling list of (score, -id) per window (low, high)) by the allowed rows; the rows scored."""
        points, q = self.numbers(query)
        n = len(self.ids)
        used = np.flatnonzero(q != 0)
        if not len(used):
            used = np.zeros(1, int)  # all scores are 0: any list visits every row
        lists, falling = self.lists[used], (q[used] > 0).astype(bool)
        open_rows = allowed.copy()
        scored, depth = 0, 0
        while depth < n:
            last = min(n, depth + step)
            seen = np.where(falling[:, None], lists[:, n - last:n - depth][:, ::-1], lists[:, depth:last])
            reached = np.zeros(n, bool)
            reached[seen] = True
            fresh = np.flatnonzero(reached & open_rows)
            open_rows[fresh] = False
            if len(fresh):
                scored += len(fresh)
                self.keep(fresh, points.take(fresh, 0) @ q, windows, best, k)
            depth, step = last, step * 2
            threshold = points[seen[:, -1], used] @ q[used]  # no unseen row can have more
            if not open_rows.any() or all(threshold < (max(low, b[-1][0]) if len(b) == k else low) for (low, _), b in zip(windows, best)):
                break
        return scored

    def keep(self, rows: np.ndarray, scores: np.ndarray, windows: Sequence[tuple], best: list[list[tuple]], k: int) -> None:
        """Take the best of newly scored rows into every window: they are sorted once, a window is a stretch of them."""
        least = [held[-1][0] if len(held) == k else low for (low, _), held in zip(windows, best)]
        good = np.flatnonzero(scores >= min(least, default=0))
        if not len(good):
            return
        good = good[np.lexsort((self.ids[rows[good]], -scores[good]))]
        falling, ids = -scores[good], self.ids[rows[good]]
        for (low, high), floor, held in zip(windows, least, best):
            start = np.searchsorted(falling, -high) if falling[0] < -high else 0
            found = [(int(-s), -int(i)) for s, i in zip(falling[start:start + k], ids[start:start + k]) if -s >= floor]
            if found:
                held.extend(found)
                held.sort(reverse=True)
                del held[k:]


def shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A stored row per shard. ``rows`` has id, label, dim, v; rows of one label lie together, a large label has many shards."""
    dealt = numbered(rows, ["dim", "label", F.xxhash64("id"), "id", "v"], "dealt")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(int(frame["dim"].iloc[0]), frame["id"].to_numpy(), frame["label"].to_numpy(), frame["v"])
        return pd.DataFrame([shard.packed(int(frame["shard"].iloc[0]))], columns=[c.split()[0] for c in SHARD.split(", ")])

    cut = dealt.withColumn("shard", F.floor(F.col("number") / F.lit(shard_rows)).cast("long"))
    return stored(cut.groupBy("dim", "shard").applyInPandas(build, SHARD), "sorted-lists")


def search(lists: DataFrame, asked: list[tuple], same_label: bool, k: int, scale: int, step: int = STEP) -> DataFrame:
    """Stored (anchor, window, id, score): each task's best k for every window of (anchor, id, label, vector, windows)."""
    spark = lists.sparkSession
    sent = spark.sparkContext.broadcast(asked)

    def run(batches):
        anchors = [(a, i, label, len(v), padded(v), w, [[] for _ in w]) for a, i, label, v, w in sent.value]
        for frame in batches:
            for row in frame.itertuples(index=False):
                shard = Shard.unpacked(row, scale)
                for _, own, label, dim, v, windows, best in anchors:
                    if dim != row.dim:
                        continue
                    code = shard.labels.get(label, -1)
                    if same_label and code < 0:
                        continue
                    allowed = ((shard.codes == code) & (shard.ids != own)) if same_label else shard.codes != code
                    if allowed.any():
                        shard.search(v, allowed, windows, best, k, step)
        found = [(a, w, -other, score) for a, *_, best in anchors for w, held in enumerate(best) for score, other in held]
        if any(not -(2**63) <= f[3] < 2**63 for f in found):
            raise OverflowError("a score does not fit 64 bits")
        yield pd.DataFrame(found, columns=["anchor", "window", "id", "score"]).astype({"anchor": "int64", "window": "int32", "id": "int64", "score": "int64"})

    try:
        with batch_rows(spark, SHARDS_AT_ONCE):
            found = stored(lists.repartition("shard").mapInPandas(run, FOUND), "found")
    finally:
        sent.destroy()
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def band(score: int, hundredths: tuple[int, int] = BAND) -> tuple[int, int]:
    """Smallest and largest whole score within the band of a positive's."""
    return -(-hundredths[0] * score // 100), hundredths[1] * score // 100


def hard_negatives(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, hundredths: tuple[int, int] = BAND, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
                   block_anchors: int = BLOCK_ANCHORS, step: int = STEP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row whose ``id`` meets ``anchors``."""
    rows = stored(usable(df, key, vector, column(label) if isinstance(label, str) else label), "vectors")
    spark = rows.sparkSession
    asked = numbered(rows.where(anchors), ["id", "label", "v"], "anchors", "anchor").withColumn("block", F.floor(F.col("anchor") / F.lit(block_anchors)))
    asked = stored(asked, "blocks", ["block"])
    lists = shards(rows, shard_rows)
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(-(-asked.count() // block_anchors)):
        one = asked.where(F.col("block") == block)
        held = [(r["anchor"], r["id"], r["label"], r["v"]) for r in one.select("anchor", "id", "label", "v").collect()]  # one block
        near = search(lists, [(*a, [(float("-inf"), float("inf"))]) for a in held], True, positives, scale, step)
        scores: dict[int, list[int]] = {}
        for r in near.select("anchor", "score").distinct().collect():  # at most ``positives`` rows an anchor of the block
            scores.setdefault(r["anchor"], []).append(r["score"])
        wanted = [(*a, scores[a[0]]) for a in held if a[0] in scores]
        windows = [(a, i, name, v, [band(s, hundredths) for s in s_list]) for a, i, name, v, s_list in wanted]
        far = search(lists, windows, False, negatives, scale, step)
        named = spark.createDataFrame([(a, i, w, s) for a, i, _, _, s_list in wanted for w, s in enumerate(s_list)], "anchor long, anchor_id long, window int, positive_score long")
        pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(named, ["anchor", "positive_score"])
        result = result.unionByName(pairs.join(far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["anchor", "window"]).select(result.columns))
    return result
