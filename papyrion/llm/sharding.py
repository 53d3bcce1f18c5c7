"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: for each slot the index of its shard.

    Every shard prefers the slots in an order of its own, (offset + k * skip) mod slots with both
    numbers from a digest of its name; the shards take turns, each claiming its next free preference.
    Shards get equally many slots but for one, and adding a shard moves few slots besides its own.
    """
    if not shards or len(set(shards)) != len(shards) or not _is_prime(slots) or len(shards) > slots:
        raise ValueError("shards must be distinct and no more than the slots, whose number is prime")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def names(n_shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n_shards)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the key's text; all null keys share one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots


def assign(docs: DataFrame, n_shards: int = 64, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``shard`` (int): one array look-up per row, no shuffle.

    The table has a fixed number of slots and travels with the plan as one literal. An existing column
    ``shard`` is replaced. Rows with equal keys share a shard.
    """
    table = F.split(F.lit(",".join(map(str, fill(names(n_shards), slots)))), ",").cast("array<int>")
    return docs.withColumn("shard", F.element_at(table, (slot_of(F.col(key), slots) + 1).cast("int")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 64, key: str = "doc_id", spread: int = 4) -> None:
    """Write ``docs`` as Parquet, one folder for each shard, in ``spread`` files a shard."""
    placed = assign(docs, n_shards, key)
    placed.repartition(n_shards * spread, "shard", F.pmod(F.xxhash64(key), F.lit(spread))).write.partitionBy("shard").parquet(path)
