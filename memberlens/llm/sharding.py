"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns, and each turn
claims the first slot of its order that is still free, until the table is full. A key's hash picks a slot and the slot
names the shard. Adding or losing a shard moves little besides its own share. The table has a fixed size, set by a
parameter, and is broadcast; a row costs one hash and one lookup.

Defined results: a null key has the hash of the empty string and so one fixed shard; equal keys share a shard; an empty
table gives no rows; the result has the columns ``key``, ``slot`` and ``shard`` only, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well over a hundred times the number of shards keeps shares within one percent.
TABLE_SIZE = 65_537


def preference(name: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's order of preference, from its name."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position in ``shards`` of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    orders = [preference(s, size) for s in shards]
    at = [start for start, _ in orders]
    owner = [-1] * size
    claimed = 0
    while True:
        for i, (_, step) in enumerate(orders):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            owner[at[i]] = i
            claimed += 1
            if claimed == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of the md5 of its text, modulo the table size."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """key, slot and shard of every row."""
    owner = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    table = df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "owner"))
    table = table.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    return df.select(F.col(key).alias("key")).withColumn("slot", slot_of(F.col("key"), size)).join(F.broadcast(table), "slot").select("key", "slot", "shard")


def moved_share(old: Sequence[str], new: Sequence[str], size: int = TABLE_SIZE) -> float:
    """Share of slots whose shard differs between two lists of shards."""
    a, b = fill_table(old, size), fill_table(new, size)
    return sum(old[x] != new[y] for x, y in zip(a, b)) / size
