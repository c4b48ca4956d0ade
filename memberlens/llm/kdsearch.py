"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt over shards of bounded size and one length. A shard builds a KD-tree: the widest dimension is split at its
median until leaves are small, and every node keeps the tight box of its vectors. A query walks the tree best-first: the
largest inner product that a box allows orders the queue, and the walk ends when no box can reach the query's kth best score
so far. The first round searches one shard per length, its kth scores go with the queries to all shards, and inside a task
the kth score goes on from shard to shard.

Components are whole numbers, floor(scale * x), so scores are exact and ties are decided by the smaller id: sums of products
are formed in 64-bit floats where those are exact, else in Python's whole numbers.

Queries are dealt to blocks of fixed size in a stored table; one block at a time is broadcast for a pass over the stored trees
and given up afterwards.

Defined results: vectors that are null or hold null or non-finite components take no part, as candidate or as query; so do null
ids. A vector meets those of its own length only. Rows that repeat an id and vector are one candidate; a query never finds its
own id; several vectors of one id are several queries; fewer candidates than k give fewer rows; a score beyond 64 bits in the
result is an error. Only id and vector are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import column
from memberlens.llm.exact import exact, fits, floors, padded
from memberlens.llm.order import batch_rows, numbered
from memberlens.sources.tables import stored

SCALE = 1024
K = 10

#: Vectors in a shard, in a leaf of its tree, queries in a block, and shards in a batch.
SHARD_ROWS = 4_096
LEAF_ROWS = 64
BLOCK_QUERIES = 4_096
SHARDS_AT_ONCE = 4

TREE = "shard long, dim int, ids binary, points binary, starts binary, ends binary, left binary, low binary, high binary"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v): distinct rows that take part."""
    rows = df.select(column(key).cast("long").alias("id"), column(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).select("id", F.size("v").alias("dim"), "v").distinct()


class Tree:
    """KD-tree over the rows of ``points``; nodes are arrays, a leaf has no left child and the right child follows the left."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS, scale: int = 1):
        order = np.arange(len(points))
        starts, ends, left, low, high = [0], [len(points)], [-1], [], []
        node = 0
        while node < len(starts):
            a, b = starts[node], ends[node]
            part = points[order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            if b - a > leaf:
                widest = int((high[-1] / 2 - low[-1] / 2).argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
                left[node] = len(starts)
                starts += [a, a + middle]
                ends += [a + middle, b]
                left += [-1, -1]
            node += 1
        self.fill(points[order], ids[order], np.array(starts), np.array(ends), np.array(left), np.array(low), np.array(high), scale)

    def fill(self, points, ids, starts, ends, left, low, high, scale: int) -> None:
        """``points``, ``low`` and ``high`` are as they came, before scaling."""
        self.raw, self.ids, self.starts, self.ends, self.left, self.scale = (points, low, high), ids, starts, ends, left, scale
        self.whole = tuple(floors(x, scale) for x in self.raw)
        self.points, self.low, self.high = self.whole
        self.largest = float(np.abs(self.points).max(initial=0))
        self.exact = None

    def numbers(self, query: np.ndarray):
        """Points, boxes and query in numbers whose sums of products are exact."""
        q = floors(query, self.scale)
        if fits(self.largest, q):
            return *self.whole, q
        if self.exact is None:
            self.exact = tuple(exact(x, self.scale) for x in self.raw)
        return *self.exact, exact(query, self.scale)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows."""
        _, low, high, q = self.numbers(query)
        return np.where(q > 0, high, low) @ q

    def search(self, query: np.ndarray, own: int, k: int, floor: float, best: list[tuple] | None = None) -> list[tuple]:
        """The best k (score, -id) of other ids with a score of ``floor`` at least, together with the heap ``best`` so far."""
        points, low, high, q = self.numbers(query)
        bound = np.where(q > 0, high, low) @ q
        best = [] if best is None else best
        least = max(floor, best[0][0]) if len(best) == k else floor
        queue = [(-bound[0], 0)]
        while queue and -queue[0][0] >= least:
            node = heapq.heappop(queue)[1]
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= least:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            a, b = self.starts[node], self.ends[node]
            score = points[a:b] @ q
            for i in np.flatnonzero(score >= least):
                found = (int(score[i]), -int(self.ids[a + i]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
                if len(best) == k:
                    least = max(least, best[0][0])
        return best


def packed(tree: Tree, shard: int, dim: int) -> tuple:
    points, low, high = tree.raw
    arrays = [tree.ids, points, tree.starts, tree.ends, tree.left, low, high]
    return shard, dim, *(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(row, scale: int) -> Tree:
    tree = Tree.__new__(Tree)
    ids, starts, ends, left = (np.frombuffer(x, np.int64) for x in (row.ids, row.starts, row.ends, row.left))
    points, low, high = (np.frombuffer(x, np.float64).reshape(-1, max(1, row.dim)) for x in (row.points, row.low, row.high))
    tree.fill(points, ids, starts, ends, left, low, high, scale)
    return tree


def trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """One stored row per shard with its tree. ``vectors`` has id, dim and v."""
    dealt = numbered(vectors, ["dim", F.xxhash64("id"), "id", "v"], "dealt")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        tree = Tree(np.stack([padded(v) for v in frame["v"]]), frame["id"].to_numpy(), leaf)
        return pd.DataFrame([packed(tree, int(frame["shard"].iloc[0]), int(frame["dim"].iloc[0]))], columns=[c.split()[0] for c in TREE.split(", ")])

    cut = dealt.withColumn("shard", F.floor(F.col("number") / F.lit(shard_rows)).cast("long"))
    return stored(cut.groupBy("dim", "shard").applyInPandas(build, TREE), "kd-trees")


def search(forest: DataFrame, block: list[tuple], k: int, scale: int) -> DataFrame:
    """Stored (query, vec_id, score): each task's best k for a block of (query, id, vector, floor)."""
    spark = forest.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches):
        asked = [(n, own, len(v), padded(v), floor, []) for n, own, v, floor in sent.value]
        for frame in batches:
            for row in frame.itertuples(index=False):
                tree = unpacked(row, scale)
                for _, own, dim, v, floor, best in asked:
                    if dim == row.dim:
                        tree.search(v, own, k, floor, best)
        found = [(n, -other, score) for n, *_, best in asked for score, other in best]
        if any(not -(2**63) <= f[2] < 2**63 for f in found):
            raise OverflowError("a score does not fit 64 bits")
        yield pd.DataFrame(found, columns=["query", "vec_id", "score"], dtype="int64")

    try:
        with batch_rows(spark, SHARDS_AT_ONCE):
            return stored(forest.repartition("shard").mapInPandas(run, "query long, vec_id long, score long"), "found")
    finally:
        sent.destroy()


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every vector whose ``id`` meets ``queries``."""
    rows = stored(usable(vectors, key, vector), "vectors")
    forest = trees(rows, shard_rows)
    first = forest.join(forest.groupBy("dim").agg(F.min("shard").alias("shard")), ["dim", "shard"], "left_semi")
    asked = numbered(rows.where(queries), ["id", "v"], "asked", "query").withColumn("block", F.floor(F.col("query") / F.lit(block_queries)))
    asked = stored(asked, "blocks", ["block"])
    out = rows.sparkSession.createDataFrame([], "query long, query_id long, vec_id long, score long")
    for b in range(-(-asked.count() // block_queries)):
        one = asked.where(F.col("block") == b)
        block = [(r["query"], r["id"], r["v"], float("-inf")) for r in one.select("query", "id", "v").collect()]  # one block
        kth = search(first, block, k, scale).groupBy("query").agg(F.collect_list("score").alias("s"))
        floors_ = {r["query"]: sorted(r["s"])[-k] for r in kth.collect() if len(r["s"]) >= k}  # at most k scores a task and query
        found = search(forest, [(n, i, v, floors_.get(n, low)) for n, i, v, low in block], k, scale)
        out = out.unionByName(found.join(one.select("query", F.col("id").alias("query_id")), "query").select(out.columns))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id")))
    return out.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
