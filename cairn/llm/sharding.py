"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, from two hashes of its
name. Shards take turns; at its turn a shard claims the first slot of its permutation that
is still free (a shard of weight w has w turns a round). Rows find their shard by one
look-up of the slot that their key hashes to, in a broadcast table of fixed size. When
shards come or go, most slots stay with their shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...], weights: dict[str, int] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The shard's place in ``shards`` for each slot. Shard names are distinct; the order of ``shards`` does not matter to which shard a slot goes."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(slots) or slots < len(shards):
        raise ValueError("give distinct shards and a prime number of slots, no fewer than shards")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    turns = [i for i in order for _ in range((weights or {}).get(shards[i], 1))]
    if not turns:
        raise ValueError("all weights are 0")
    digest = {i: hashlib.md5(shards[i].encode()).digest() for i in order}
    offset = {i: int.from_bytes(digest[i][:8], "big") % slots for i in order}
    skip = {i: int.from_bytes(digest[i][8:], "big") % (slots - 1) + 1 for i in order}
    table, at, taken = np.full(slots, -1, np.int64), dict.fromkeys(order, 0), 0
    while True:
        for i in turns:
            while table[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            at[i] += 1
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the key's MD5 modulo the slots; a null key counts as the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, weights: dict[str, int] | None = None, slots: int = SLOTS, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """The rows with their slot and shard; equal keys go to one shard, and a null key counts as the empty string. Columns of these names are replaced.

    No row is shuffled: the table, ``slots`` rows of two values, is broadcast.
    """
    slot_name, shard_name = names
    table = df.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(fill(shards, weights, slots).tolist())], f"`{slot_name}` int, `{shard_name}` string")
    rest = df.withColumn(slot_name, slot_of(key, slots)).select(*(c for c in df.columns if c not in names), slot_name)
    return rest.join(F.broadcast(table), slot_name)


def moved(spark: SparkSession, before: tuple[str, ...], after: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, before, after) of the slots whose shard differs between two sets of shards."""
    old, new = fill(before, slots=slots), fill(after, slots=slots)
    rows = [(i, before[a], after[b]) for i, (a, b) in enumerate(zip(old.tolist(), new.tolist())) if before[a] != after[b]]
    return spark.createDataFrame(rows, "slot int, before string, after string")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, by its doc_id."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))
    return place(docs, F.col("doc_id")).select("doc_id", "slot", "shard")
