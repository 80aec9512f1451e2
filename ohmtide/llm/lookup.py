"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: offset, offset + skip, offset + 2 skip, ...
The shards take turns; at its turn a shard claims the first slot of its order that is free. When all slots are claimed, each
shard has as many as any other, or one more or fewer, and when a shard goes, nearly all slots of the others stay where they are.
A key is placed by one look into the table, at its digest modulo the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table; it is what is broadcast, so its size bounds that: 12 bytes a slot.
MOST_SLOTS = 4_000_037


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> np.ndarray:
    """The shard (as an index of `shards`) that holds each slot. Shards must be distinct, and at most as many as slots."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if not is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime number from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % max(slots - 1, 1) + 1 for d in digests]
    table = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % slots
            table[slot] = i
            at[i] = (slot + skip[i]) % slots
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def slot_of(key: Column, slots: int) -> Column:
    """The first 60 bits of the key's MD5, modulo the table's size. A null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def place(rows: DataFrame, key: str, shards: list[str], slots: int = 65_537) -> DataFrame:
    """key, slot (long), shard_index (int) and shard for each row of `rows`: one narrow pass, without a shuffle.

    Rows with equal keys go to the same shard, a null key to that of the empty string; an empty table gives no rows; other
    columns are not read. The table that is broadcast has `slots` rows, whatever the input.
    """
    spark = rows.sparkSession
    table = lookup_table(shards, slots)
    names = np.array(shards, dtype=object)[table]
    import pandas as pd

    placed = spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard_index": table, "shard": names}), "slot bigint, shard_index int, shard string")
    return rows.select(F.col(key), slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(placed), "slot").select(key, "slot", "shard_index", "shard")
