"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: it starts at an offset and goes on by a skip, both
hashes of its name. The shards take turns; each claims the first free slot in its order, until the table is full. A row's
slot is a hash of its key modulo the table's size; a broadcast of the table, whose size is bounded by MAX_SLOTS, places each
row in constant time without a shuffle. Adding or taking away a shard moves few slots besides that shard's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names

#: A larger table isn't broadcast; at 8 bytes a slot this is 8 MB.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> np.ndarray:
    """The shard's number for each slot. slots must be a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(min(len(shards), free)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
    return np.array(owner, np.int32)


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the table's size; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def shard(df: DataFrame, key: str = "doc_id", shards: int = 64, slots: int = 16381, out: str = "shard") -> DataFrame:
    """df with a column of the shard's number.

    Null keys share one slot; rows with equal keys, repeated ones too, share a shard, so that ties can't arise. Empty tables stay
    empty, and texts of any length pass untouched. All other columns pass, whatever their names, but for columns named as out,
    which are replaced.
    """
    slot, owner = free_names(df, "slot", "owner")
    table = pd.DataFrame({slot: np.arange(slots, dtype=np.int64), owner: fill_table([f"shard-{k}" for k in range(shards)], slots)})
    kept = [df[c] for c in df.columns if c.lower() != out.lower()]
    placed = df.select(*kept, slot_of(df[key], slots).alias(slot))
    placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(table, f"{slot} long, {owner} int")), slot, "left")
    return placed.withColumnRenamed(owner, out).drop(slot).select(*(c for c in df.columns if c.lower() != out.lower()), out)
