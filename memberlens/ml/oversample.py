"""Minority oversampling by interpolation between near neighbours.

``bucket_neighbours`` finds near neighbours with a bounded number of visits per vector: each of several tables orders the vectors
by a code of random projections, and a vector is compared with those next to it in every table. ``nearest_neighbours`` is
exact for any vectors, but rules out little where they have no structure.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memberlens.operators.ordering import numbered
from memberlens.operators.windows import running_totals
from memberlens.sources.tables import stored

_ROUNDING = 1e-9

#: Bucket search: tables, projections in a code, neighbours on each side that a vector visits in a table, rows of a block.
TABLES = 32
BITS = 12
REACH = 64
BLOCK_ROWS = 4_096

#: Projections and distances are sums of whole numbers, floor(GRID * x), so they are the same wherever they are formed.
GRID = 1024


def _distances(queries: np.ndarray, data: np.ndarray) -> Iterable[tuple[slice, np.ndarray]]:
    """Euclidean distances of a few queries at a time, so the difference array stays small."""
    step = max(1, 4_000_000 // max(1, data.size))
    for at in range(0, len(queries), step):
        part = slice(at, at + step)
        yield part, np.sqrt(((queries[part, None, :] - data[None, :, :]) ** 2).sum(axis=2))


def nearest_neighbours(points: DataFrame, k: int = 5, pivots: int = 64, block_rows: int = 2000,
                       seed: int = 42) -> DataFrame:
    """The ``k`` nearest other rows of each distinct vector: (rep, lo, hi, neighbour vector, distance).

    ``points`` has id and vec. Equal vectors are merged first, however many there are: a vector with copies is its own
    neighbour at distance 0 for as many ranks. ``lo`` to ``hi`` are the ranks a neighbour covers with its copies.

    The search is exact. Vectors belong to the cell of their nearest pivot; cells are cut into blocks of bounded size.
    A vector's distance to its k-th neighbour is bounded by pivots and by its own block, and it visits only blocks of
    cells that the triangle inequality cannot rule out. Blocks and the visits to them are split so that no task gets
    more than about ``block_rows`` of each.
    """
    distinct = points.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # a bounded number of pivots reaches the driver
    chosen = distinct.select("rep", "vec").orderBy(F.md5(F.concat_ws(":", "rep", F.lit(seed))), "rep").limit(pivots).collect()
    if not chosen:
        raise ValueError("no points")
    centre = np.array([r["vec"] for r in chosen], dtype=float)
    near = min(k, len(chosen) - 1)

    def assign(batches):
        for batch in batches:
            x = np.array(batch["vec"].tolist(), dtype=float)
            cell, far, bound = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x))
            for part, d in _distances(x, centre):
                cell[part], far[part] = d.argmin(axis=1), d.min(axis=1)
                # one of the near + 1 closest pivots may be the vector itself
                bound[part] = np.partition(d, near, axis=1)[:, near] if near >= k else np.inf
            yield batch.assign(cell=cell, far=far, bound=bound)

    shape = "vec array<double>, rep long, copies long, cell int, far double, bound double"
    celled = distinct.select(F.col("vec").cast("array<double>").alias("vec"), "rep", "copies").mapInPandas(assign, shape)
    stats = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # one row per pivot
    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in stats}
    radius = {r["cell"]: r["radius"] for r in stats}
    cells = sorted(blocks)
    per_cell = F.create_map(*[F.lit(v) for c in cells for v in (c, blocks[c])])
    data = celled.withColumn("block", F.pmod(F.xxhash64("rep"), per_cell[F.col("cell")]).cast("int"))

    def tighten(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["vec"].tolist(), dtype=float)
        bound = frame["bound"].to_numpy(dtype=float).copy()
        if len(x) > k:
            for part, d in _distances(x, x):
                bound[part] = np.minimum(bound[part], np.partition(d, k, axis=1)[:, k])
        return frame.assign(bound=bound)[["vec", "rep", "cell", "bound"]]

    bounded = data.groupBy("cell", "block").applyInPandas(tighten, "vec array<double>, rep long, cell int, bound double")
    radii = np.array([radius[c] for c in cells])
    centres = centre[cells]

    def visit(batches):
        for batch in batches:
            x = np.array(batch["vec"].tolist(), dtype=float)
            bound = batch["bound"].to_numpy(dtype=float)
            wanted: list[list[int]] = []
            for part, d in _distances(x, centres):
                reach = d - radii[None, :] <= bound[part, None] * (1 + _ROUNDING) + _ROUNDING
                wanted += [[cells[j] for j in np.flatnonzero(row)] for row in reach]
            yield pd.DataFrame({"vec": batch["vec"], "rep": batch["rep"], "cells": wanted})

    visits = (
        bounded.mapInPandas(visit, "vec array<double>, rep long, cells array<int>")
        .select("vec", "rep", F.explode("cells").alias("cell"))
        .select("vec", "rep", "cell", F.explode(F.sequence(F.lit(0), per_cell[F.col("cell")].cast("int") - 1)).alias("block"))
    )
    load = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("parts"))
    spread = visits.join(load, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
    copies = data.join(load, ["cell", "block"]).select(
        "vec", "rep", "copies", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "neighbour": [], "copies": [], "distance": []}
        if len(queries) and len(block):
            block = block.sort_values("rep").reset_index(drop=True)
            ids, many = block["rep"].to_numpy(), block["copies"].to_numpy()
            x, q = np.array(block["vec"].tolist(), dtype=float), np.array(queries["vec"].tolist(), dtype=float)
            names = queries["rep"].to_numpy()
            for part, d in _distances(q, x):
                d[names[part, None] == ids[None, :]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                for row, order in enumerate(best):
                    keep = order[np.isfinite(d[row, order])]
                    out["rep"] += [names[part][row]] * len(keep)
                    out["neighbour"] += list(ids[keep])
                    out["copies"] += list(many[keep])
                    out["distance"] += list(d[row, keep])
        return pd.DataFrame(out).astype({"rep": "int64", "neighbour": "int64", "copies": "int64", "distance": "float64"})

    keys = ["cell", "block", "part"]
    found = spread.select("vec", "rep", *keys).groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
        search, "rep long, neighbour long, copies long, distance double")
    return with_copies(found, distinct, k)


def with_copies(found: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """Ranks of the ``k`` nearest of ``found`` (rep, neighbour, copies, distance), copies counted: see ``nearest_neighbours``."""
    order = W.partitionBy("rep").orderBy("distance", "neighbour")
    closest = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    own = distinct.select("rep", (F.col("copies") - 1).alias("_own"), F.col("vec").cast("array<double>").alias("_vec"))
    others = closest.join(own.select("rep", "_own"), "rep").join(
        own.select(F.col("rep").alias("neighbour"), F.col("_vec").alias("neighbour_vec")), "neighbour")
    upto = F.col("_own") + F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = others.select("rep", "neighbour", "neighbour_vec", "distance", (upto - F.col("copies") + 1).alias("lo"), upto.alias("hi"))
    itself = own.where(F.col("_own") > 0).select("rep", F.col("rep").alias("neighbour"), F.col("_vec").alias("neighbour_vec"),
                                                 F.lit(0.0).alias("distance"), F.lit(1).cast("bigint").alias("lo"), F.col("_own").alias("hi"))
    return itself.unionByName(ranked).where(F.col("lo") <= k)


def signs(tables: int, bits: int, dims: int, seed: int = 42) -> np.ndarray:
    """(tables, bits, dims) of +1 and -1: by the first hexadecimal digit of md5("seed:table:bit:dim"), so SQL can draw them too."""
    draws = [hashlib.md5(f"{seed}:{t}:{b}:{j}".encode()).hexdigest()[0] < "8" for t in range(tables) for b in range(bits) for j in range(dims)]
    return np.where(np.array(draws, bool).reshape(tables, bits, dims), 1.0, -1.0)


def bucket_neighbours(points: DataFrame, k: int = 5, tables: int = TABLES, bits: int = BITS, reach: int = REACH, block_rows: int = BLOCK_ROWS,
                      seed: int = 42) -> DataFrame:
    """Near neighbours of each distinct vector, in the form of ``nearest_neighbours``, from at most ``tables * 2 * reach`` visits.

    In each table a vector's bucket is the signs of ``bits`` random projections of its difference to the mean. Vectors are
    ordered by bucket, and each visits the ``reach`` ones on either side, so a small bucket probes its neighbours and a hot one
    costs no more than any other. Ranks among the visited are exact (ties: smaller id). Blocks of ``block_rows`` in that order
    meet in one task, with a seam of ``reach`` rows on both sides. Vectors have one length and whole-number differences below
    2 ** 53.
    """
    distinct = stored(points.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    grid = distinct.select("rep", "copies", F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(GRID)).cast("double")).alias("g"))
    sums = grid.select(F.posexplode("g").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("bigint")).alias("s"), F.count("*").alias("n"))
    centre = np.array([float(np.floor(r["s"] / r["n"])) for r in sums.orderBy("j").collect()])  # one row per dimension

    def coded(batches):
        planes = signs(tables, bits, len(centre), seed).reshape(tables * bits, len(centre))
        weights = 2 ** np.arange(bits)[::-1]
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at:at + 1_000]
                side = ((np.stack(part["g"].to_numpy()) - centre) @ planes.T >= 0).reshape(len(part), tables, bits)
                for t, code in enumerate((side @ weights).T):
                    yield part.assign(t=np.int32(t), code=code.astype(np.int64))

    rows = grid.mapInPandas(coded, "rep long, copies long, g array<double>, t int, code long")
    placed = numbered(rows, ["t", "code", "rep"], "bucket-order")
    block, inner = F.floor(F.col("number") / F.lit(block_rows)), F.col("number") % block_rows
    near = F.array_compact(F.array(block, F.when(inner < reach, block - 1), F.when(inner >= block_rows - reach, block + 1)))
    met = placed.withColumn("own", block).withColumn("block", F.explode(near))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", kind="stable").reset_index(drop=True)
        x, table = np.stack(frame["g"].to_numpy()), frame["t"].to_numpy()
        names, copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        n, width = len(frame), min(reach, len(frame) - 1)
        apart = np.full((n, 2 * width), np.inf)
        for step in range(1, width + 1):
            d = ((x[step:] - x[:-step]) ** 2).sum(1)
            d[table[step:] != table[:-step]] = np.inf
            apart[:-step, width + step - 1] = d
            apart[step:, width - step] = d
        own = np.flatnonzero((frame["own"] == frame["block"]).to_numpy())
        if not width or not len(own):
            return pd.DataFrame({"rep": [], "neighbour": [], "copies": [], "d": []}).astype({"rep": "int64", "neighbour": "int64", "copies": "int64", "d": "float64"})
        picked = apart[own]
        kth = np.partition(picked, min(k, 2 * width) - 1, axis=1)[:, min(k, 2 * width) - 1]
        i, j = np.nonzero((picked <= kth[:, None]) & np.isfinite(picked))  # all of a tie: the order by id follows
        at = own[i] + np.where(j >= width, j - width + 1, j - width)
        return pd.DataFrame({"rep": names[own[i]], "neighbour": names[at], "copies": copies[at], "d": picked[i, j]})

    found = met.groupBy("block").applyInPandas(search, "rep long, neighbour long, copies long, d double")
    each = found.dropDuplicates(["rep", "neighbour"]).select("rep", "neighbour", "copies", (F.sqrt("d") / F.lit(float(GRID))).alias("distance"))
    return with_copies(each, distinct, k)


def drawn(kind: str, most: Column, *parts: Column) -> Column:
    """A number from 0 below ``most``, by the first 32 bits of an md5."""
    text = F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % most


def synthetic_rows(own: DataFrame, missing: int, few: int, k: int = 5, seed: int = 42, exact: bool = False, **search) -> DataFrame:
    """(id, draw, neighbour, gap, vec): ``missing`` rows between the ``few`` ones of ``own`` (id, vec) and near neighbours."""
    if exact:
        search.setdefault("pivots", max(16, min(4096, math.isqrt(few))))
    neighbours = (nearest_neighbours if exact else bucket_neighbours)(own, k, seed=seed, **search)
    reps = own.groupBy("vec").agg(F.min("id").alias("rep"))
    numbers = running_totals(own.select("id").withColumn("one", F.lit(1)), "id", ["one"])
    times = F.lit(missing // few) + F.when(F.col("cum_one") <= missing % few, 1).otherwise(0)
    usable = min(k, few - 1)
    draws = (
        own.join(reps, "vec").join(numbers.select("id", times.cast("int").alias("_times")), "id").where(F.col("_times") > 0)
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .withColumn("_rank", drawn("rank", F.lit(usable), F.lit(seed), F.col("id"), F.col("draw")) + 1)
        .withColumn("gap", drawn("gap", F.lit(1_000_000), F.lit(seed), F.col("id"), F.col("draw")) / F.lit(1_000_000.0))
    )
    hit = neighbours.withColumnRenamed("rep", "_rep")
    joined = draws.join(hit, (F.col("rep") == F.col("_rep")) & F.col("_rank").between(F.col("lo"), F.col("hi")))
    between = F.zip_with(F.col("vec").cast("array<double>"), "neighbour_vec", lambda a, b: a + F.col("gap") * (b - a))
    return joined.select("id", "draw", "neighbour", "gap", between.alias("vec"))


def oversampled(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42, minority: int = 1, exact: bool = False, **search) -> DataFrame:
    """Rows (id, vec, label) plus synthetic minority rows until both classes have the same size.

    A synthetic row lies between a minority row and one of its ``k`` near minority neighbours (``exact``: nearest ones, by a
    search without a bound on visits), at a place drawn from a seeded hash. Every minority row is used equally often, give or
    take one.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(label) == minority).count().collect()}  # two rows
    few, many = sizes.get(True, 0), sizes.get(False, 0)
    missing = many - few
    rows = df.select("id", F.col("vec").cast("array<double>").alias("vec"), label, F.lit(False).alias("synthetic"))
    if few < 2 or missing <= 0:
        return rows
    made = synthetic_rows(df.where(F.col(label) == minority).select("id", "vec"), missing, few, k, seed, exact, **search)
    return rows.unionByName(made.select("id", "vec", F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(True).alias("synthetic")))
