"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

A file is a Parquet table with one row per block of whole documents in ascending order of key. A block holds

* ``ranked``: its distinct ids from the most to the least frequent (ties: smaller id first), little-endian unsigned 32-bit;
* ``control``: two bits per token, four tokens a byte, lowest bits first: the number of data bytes of the token less one;
* ``data``: the rank of each token in that many little-endian bytes;
* ``keys``, ``counts``: the documents and their numbers of tokens, signed 64-bit; ``first``: tokens before the block in
  its partition; ``tokens``: those in it; ``part``: the number of the partition.

Blocks rank by their own counts, so one pass over the texts writes them, frequent ids take one byte, and any block can be
read alone. Decoding finds byte lengths by a table over control bytes and gathers the ranks with numpy.

Defined results: null texts are empty; an empty text has the end id alone; a null key is written as the smallest key and
comes back as null; rows that repeat a key stay separate rows; an empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from memberlens.llm.common import in_text_batches, small_batches
from memberlens.llm.tokens import encoded

#: Tokens after which a block ends; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 20

#: Ids below this are ranked by a table over all of them.
TABLE_IDS = 1 << 22

BLOCKS = "part int, block int, first long, tokens long, keys binary, counts binary, ranked binary, control binary, data binary"
NULL_KEY = np.iinfo(np.int64).min


def code_table() -> np.ndarray:
    """Byte lengths of the four tokens of each control byte."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6])
    return ((codes & 3) + 1).astype(np.uint8)


LENGTHS = code_table()


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of unsigned 32-bit ids."""
    top = int(ids.max()) if len(ids) else 0
    if top < TABLE_IDS:  # any vocabulary: counted and ranked by tables over the ids, without a sort of the tokens
        every = np.bincount(ids, minlength=1)
        values = np.flatnonzero(every)
        counts, place = every[values], ids
    else:
        values, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank_of = np.empty(top + 1 if top < TABLE_IDS else len(order), np.uint32)
    rank_of[values[order] if top < TABLE_IDS else order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[place]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        data[starts[has] + k] = ranks[has] >> np.uint32(8 * k) & np.uint32(0xFF)
    return values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ids(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block of ``n`` tokens."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        has = size > k
        ranks[has] |= raw[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                      end_id: int | None = 0, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None) -> None:
    """Encode every whole text and write the blocks under ``path``, in ascending key order over partitions and blocks."""

    def blocks(batches):
        part, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int] = []
        parts: list[bytes] = []

        def block_row() -> pd.DataFrame:
            counts = np.array([len(x) // 4 for x in parts], np.int64)
            coded = encode_ids(np.frombuffer(b"".join(parts), "<u4"))
            row = (part, block, first, size, np.array(keys, np.int64).tobytes(), counts.tobytes(), *coded)
            return pd.DataFrame([row], columns=["part", "block", "first", "tokens", "keys", "counts", "ranked", "control", "data"])

        for frame in small_batches(batches, "text"):
            names = frame["key"].fillna(NULL_KEY).astype("int64") if frame["key"].isna().any() else frame["key"].astype("int64")
            for name, ids in zip(names, encoded(frame["text"], vocabulary, end_id)):
                keys.append(int(name))
                parts.append(ids)
                size += len(ids) // 4
                if size >= block_tokens:
                    yield block_row()
                    block, first, size = block + 1, first + size, 0
                    keys, parts = [], []
        if keys:
            yield block_row()

    rows = in_text_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = ["key", F.xxhash64("text")]  # one key may hold a large share of all rows: its texts then lie in several ranges
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).mapInPandas(blocks, BLOCKS).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids."""

    def documents(batches):
        for frame in batches:
            for row in frame.itertuples(index=False):
                keys, counts = np.frombuffer(row.keys, np.int64), np.frombuffer(row.counts, np.int64)
                ids = decode_ids(row.ranked, row.control, row.data, int(counts.sum())).tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                texts = [ids[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({
                    "doc_id": pd.Series(keys, dtype="Int64").mask(keys == NULL_KEY), "start": starts + row.base + row.first,
                    "n_tokens": counts, "ids_crc32": [zlib.crc32(x) for x in texts], "ids": texts,
                })

    files = spark.read.schema(BLOCKS).parquet(path)
    ends = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the writer
    bases = ends.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    based = files.join(F.broadcast(bases), "part").drop("part", "block")
    return based.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")

