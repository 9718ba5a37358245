"""Sharding by a permutation-filled lookup table (the Maglev scheme, Eisenbud et al., 2016).

Every shard has a permutation of the slots of a prime-sized table, from two hashes
of its name. Shards take turns claiming their next free slot until the table is
full, so shares are even to one slot and a shard that leaves moves few other keys.
A row's slot is its hashed key modulo the table size; the table goes to the
executors as a broadcast of ``slots`` rows, a fixed number whatever the data.

Defined results: rows with equal keys go to one shard; a null key is the key of
null; repeated rows keep their count; an empty table gives an empty result; other
columns stay, and the added names replace columns of the same names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that holds each slot."""
    if not _is_prime(slots) or not shards or len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("slots must be a prime of at least the number of shards, and shards distinct names")
    start = [zlib.crc32(s.encode()) % slots for s in shards]
    skip = [zlib.crc32(b"skip:" + s.encode()) % (slots - 1) + 1 for s in shards]
    # step n of a shard's preference order is start + n * skip: a permutation, as slots is prime
    out = [-1] * slots
    at = list(start)  # the slot that each shard looks at next
    free = slots
    while free:
        for i, step in enumerate(skip[:free]):
            slot = at[i]
            while out[slot] >= 0:
                slot = (slot + step) % slots
            out[slot] = i
            at[i] = (slot + step) % slots
            free -= 1
    return np.array(out, np.int32)


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with the slot and the shard name of each row; no shuffle."""
    held = fill(shards, slots)
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(held.tolist())], f"`{slot_name}` int, `{shard_name}` string")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_name.lower(), shard_name.lower())], slot_of(*[F.col(f"`{k}`") for k in keys], slots=slots).alias(slot_name))
    return rows.join(F.broadcast(lookup), slot_name, "left")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, slots: int = SLOTS, salt: int = 1) -> None:
    """Writes one folder a shard; ``salt`` tasks share a shard's rows, for shards that a hot key makes large."""
    placed = place(df, keys, shards, slots)
    placed.repartition("shard", F.pmod(F.monotonically_increasing_id(), F.lit(salt))).write.partitionBy("shard").parquet(path)
