"""Sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 4099  # prime


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[str]:
    """Shards take turns; each claims the first free slot of its own permutation of the slots.

    Every shard gets ``size / len(shards)`` slots, give or take one, and removing a shard moves few of the other slots.
    """
    if not shards or len(shards) > size or any(size % x == 0 for x in range(2, int(size**0.5) + 1)):
        raise ValueError("needs 1 to size shards and a prime size")
    order = []
    for s in shards:
        h = hashlib.sha256(s.encode()).digest()
        order.append((int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1))
    table: list[str | None] = [None] * size
    turn, left = [0] * len(shards), size
    while left:
        for i, (offset, skip) in enumerate(order):
            while table[slot := (offset + turn[i] * skip) % size] is not None:
                turn[i] += 1
            table[slot] = shards[i]
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of those names are replaced. A null key hashes as the empty string.

    The table (``size`` rows, whatever the input) is broadcast: placement is one hash and one probe, with no shuffle.
    Equal keys always meet in one shard. An empty input gives no rows.
    """
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, shard string")
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), size))
    return keyed.join(F.broadcast(table), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", files_per_shard: int = 8) -> None:
    """One folder for each shard; a shard's rows are dealt over ``files_per_shard`` tasks."""
    placed = assign_shards(df, shards, key)
    placed.repartition(len(shards) * files_per_shard, "shard", F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
