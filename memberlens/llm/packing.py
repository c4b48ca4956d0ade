"""Hierarchical best-fit packing of token sequences.

Texts become pieces of at most ``capacity`` tokens. Pieces are dealt over groups of bounded size, in turns from the longest down,
so that every group has its share of each length and finds partners for it; each group packs its own by best fit, longest
first. Bins that no other open bin fits into are finished; the others become items of the next round, dealt in the same way
by their fill, and bins are best-fitted as a whole. Rounds go on until a single group was packed or a round joins less than
one in ``LITTLE`` of its bins. Every group holds two numbers per bin, never texts or ids, and never more than ``group_items``.

Defined results: a null or empty text is the end id alone; equal lengths are packed in order of document and piece; rows
that repeat a ``doc_id`` are packed one by one (give them distinct keys first if they must be told apart); an empty table
gives no rows. Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import by_small_batches, in_text_batches
from memberlens.llm.order import numbered
from memberlens.llm.tokens import encoded
from memberlens.sources.tables import stored

CAPACITY = 2048

#: Pieces, and later open bins, that one group packs. More groups follow from more rows.
GROUP_ITEMS = 100_000

#: A round that joins fewer than one in so many bins is the last.
LITTLE = 1_000


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0,
           capacity: int = CAPACITY) -> DataFrame:
    """Ids of every whole text, cut into pieces only where a document is longer than ``capacity``.

    Returns doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian unsigned 32-bit).
    """

    @by_small_batches("text")
    def cut(batches):
        for frame in batches:
            ids = list(encoded(frame["text"], vocabulary, end_id))
            step = 4 * capacity
            rows = [(k, i // step, i // 4, x[i:i + step]) for k, x in zip(frame["doc_id"], ids) for i in range(0, len(x), step)]
            key_, piece, start, part = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({
                "doc_id": pd.Series(key_, dtype="Int64"), "piece": pd.Series(piece, dtype="int32"),
                "start": pd.Series(start, dtype="int64"), "length": pd.Series([len(x) // 4 for x in part], dtype="int64"),
                "ids": pd.Series(part, dtype="object"),
            })

    schema = "doc_id long, piece int, start long, length long, ids binary"
    return in_text_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best fit from the longest down.

    Open bins are kept by free space; a bit set of the spaces in use finds the tightest one that is large enough.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = in_use >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            where = by_space[space].pop()
            if not by_space[space]:
                in_use ^= 1 << space
        else:
            space, where = capacity, opened
            opened += 1
        bins[i], offsets[i] = where, capacity - space
        left = space - n
        if left:
            by_space[left].append(where)
            in_use |= 1 << left
    return bins, offsets


def packed_group(capacity: int, bundle: int = 0):
    """Best fit of one group: item, length -> item, bin (named by its first item), offset, fill.

    With ``bundle``, bins that stay more than that below the capacity are taken apart again, into runs of items that hold at
    most ``bundle`` together (or one item): the next round can place those better than it could the whole bin.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        if bundle:
            loose = np.flatnonzero(fill[bins] < capacity - bundle)
            place, last, fresh = 0, -1, len(fill)
            for i in loose[np.lexsort((offsets[loose], bins[loose]))].tolist():
                if bins[i] != last or place + lengths[i] > bundle:
                    last, place, fresh = bins[i], 0, fresh + 1
                bins[i], offsets[i] = fresh - 1, place
                place += lengths[i]
            fill = np.bincount(bins, weights=lengths, minlength=fresh).astype(np.int64)
        first = np.zeros(len(fill), np.int64)
        item = frame["item"].to_numpy()
        first[bins[::-1]] = item[::-1]
        return pd.DataFrame({"item": item, "bin": first[bins], "offset": offsets, "fill": fill[bins]})

    return run


def packing_round(items: DataFrame, groups: int, capacity: int, bundle: int = 0) -> DataFrame:
    """One round: (item, length) -> (item, bin, offset, fill), each group by itself."""
    if groups > 1:
        items = numbered(items, [F.desc("length"), F.xxhash64("item"), "item"], "by-length").withColumn("part", F.col("number") % groups)
    else:
        items = items.withColumn("part", F.lit(0).cast("long"))
    return items.groupBy("part").applyInPandas(lambda g: packed_group(capacity, bundle)(g), "item long, bin long, offset long, fill long")


def pack(lengths: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item, length) -> (item, sequence_id, offset), in as few sequences of at most ``capacity`` as the rounds find.

    ``item`` is a distinct number per row. Lengths run from 1 to ``capacity``.
    """
    full = lengths.where(F.col("length") >= capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = lengths.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    placed = stored(packing_round(rest, groups, capacity, capacity // 8 if groups > 1 else 0), "packing-0")
    open_bins = placed.groupBy("bin").agg(F.max("fill").alias("fill"))
    placed = placed.select("item", "bin", "offset")
    level = 0
    while groups > 1:
        smallest = open_bins.agg(F.min("fill")).first()[0]
        # A bin that the smallest one does not fit into can never be joined: fills only grow.
        items = open_bins.where(F.col("fill") + F.lit(smallest) <= capacity).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        rows = items.count()
        if rows < 2:
            break
        groups = -(-rows // group_items)
        level += 1
        merged = stored(packing_round(items, groups, capacity), f"packing-{level}")
        # a bin that keeps its name may still stand behind a longer one
        joined = merged.where((F.col("item") != F.col("bin")) | (F.col("offset") != 0)).select(
            F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        placed = placed.join(joined, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        open_bins = merged.groupBy("bin").agg(F.max("fill").alias("fill"))
        if (rows - open_bins.count()) * LITTLE < rows:
            break
    return full.unionByName(placed).withColumnRenamed("bin", "sequence_id")


def packed_documents(cut: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Places of stored pieces: the columns of ``cut`` with sequence_id and offset.

    ``cut`` has doc_id, piece and length; it should be stored, because it is read more than once.
    """
    numbered = cut.withColumn("item", F.monotonically_increasing_id())
    numbered = stored(numbered, "pieces")
    places = pack(numbered.select("item", "length"), capacity, group_items)
    return numbered.join(places, "item").drop("item")


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Packing of every document: the digest of each piece and its ids beside it."""
    cut = stored(pieces(docs, vocabulary, capacity=capacity).withColumn("item", F.monotonically_increasing_id()), "pieces", compression="zstd")
    return cut.join(pack(cut.select("item", "length"), capacity), "item").drop("item").withColumn("ids_crc32", F.crc32("ids"))


def packed_digest(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Packing of every document, with a checksum in place of the ids of each piece."""
    cut = pieces(docs, vocabulary, capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed_documents(cut, capacity)
