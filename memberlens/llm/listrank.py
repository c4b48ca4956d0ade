"""Distributed list ranking: the place of every element of one linked list.

Elements are numbered densely. Blocks of neighbouring numbers first follow their links inside the block, so that only the
elements that are entered from another block stay; a list whose order mostly follows the numbers shrinks to a few per block. If
more are left than one task may hold, rounds of coin tosses let every element with a head take in a successor with a tail (a
quarter of the list each time). The last few are ranked in one task of bounded size, and places go back the way they came.
Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.sources.tables import stored

#: Elements of a block, and of the list that one task finishes.
BLOCK = 65_536
FINISH = 262_144

WALKED = "id long, head long, offset long, next long, length long"


def walk(ids: np.ndarray, following: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths inside a set of elements (-1: no next): per element its path's first element and the lengths before it; for
    first elements also what follows the path and its length."""
    order = np.argsort(ids, kind="stable")
    ids, following, lengths = ids[order], following[order], lengths[order]
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, following), n - 1)
    inside = ids[at] == following
    pointer = np.arange(n)
    pointer[at[inside]] = np.flatnonzero(inside)
    first = pointer == np.arange(n)
    offset = np.where(first, 0, lengths[pointer])
    while not first[pointer].all():
        offset += np.where(first[pointer], 0, offset[pointer])
        pointer = pointer[pointer]
    last = np.flatnonzero(~inside)
    out, total = np.full(n, -1), np.zeros(n, np.int64)
    out[pointer[last]], total[pointer[last]] = following[last], offset[last] + lengths[last]
    return ids, ids[pointer], offset, out, total


def walked(frame: pd.DataFrame) -> pd.DataFrame:
    found = walk(*(frame[c].to_numpy(np.int64) for c in ("id", "next", "length")))
    return pd.DataFrame(dict(zip(("id", "head", "offset", "next", "length"), found)))


def toss(current: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of coins: (what is left of the list, what went as (id, head, offset))."""
    heads = F.xxhash64(F.col("id"), F.lit(turn)).bitwiseAND(1) == 1
    takers = current.where(heads)
    given = current.where(~heads)
    taken = given.select(F.col("id").alias("next"), F.col("id").alias("taken"), F.col("next").alias("further"), F.col("length").alias("more"))
    grown = stored(takers.join(taken, "next", "left"), "list-taken")
    gone = grown.where("taken is not null").select(F.col("taken").alias("id"), F.col("id").alias("head"), F.col("length").alias("offset"))
    left = grown.select("id", F.when(F.col("taken").isNull(), F.col("next")).otherwise(F.col("further")).alias("next"),
                        (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
    return stored(left.unionByName(given.join(gone, "id", "left_anti")), "list"), gone


def ranked(links: DataFrame, block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """(id, place from 0) of every element of (id, next); the last one's ``next`` is -1."""
    cut = links.select("id", "next", F.lit(1).cast("long").alias("length"), F.floor(F.col("id") / F.lit(block)).alias("block"))
    first = stored(cut.groupBy("block").applyInPandas(walked, WALKED), "list-walked")
    steps = [first.where("id <> head").select("id", "head", "offset")]
    current = first.where("id = head").select("id", "next", "length")
    turn = 0
    while current.count() > finish:
        current, gone = toss(current, turn)
        steps.append(gone)
        turn += 1
    places = current.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(walked, WALKED).select("id", F.col("offset").alias("place"))
    for gone in reversed(steps):
        back = gone.join(places.withColumnRenamed("id", "head"), "head").select("id", (F.col("place") + F.col("offset")).alias("place"))
        places = stored(places.unionByName(back), "list-places")
    return places
