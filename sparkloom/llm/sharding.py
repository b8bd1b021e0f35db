"""Shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table. Shards take turns, each claiming the next free
slot of its permutation, until the table is full; so shards differ by at most one slot, and a change of the shard list
moves few slots. A key's shard is the table's entry at its hash modulo the size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each shard, at least.
SLOTS_PER_SHARD = 100


def _prime_from(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(n_shards: int) -> int:
    return _prime_from(SLOTS_PER_SHARD * n_shards)


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation; size is prime, so that any step visits every slot."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int | None = None) -> list[int]:
    """For each slot the index of its shard. The shards' order does not matter: they take turns by name."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    size = size or table_size(len(shards))
    if _prime_from(size) != size or size < len(shards):
        raise ValueError("the size must be a prime, and no less than the number of shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: preference(shards[i], size) for i in turns}
    table, left = [-1] * size, size
    while left:
        for i in turns[:left]:
            slot, step = at[i]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], at[i] = i, (slot, step)
            left -= 1
    return table


def slot(key: Column, size: int) -> Column:
    """The key's MD5, of which 15 hexadecimal digits count, modulo the size; a null key is like an empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def _table(df: DataFrame, shards: Sequence[str], size: int | None) -> tuple[DataFrame, int]:
    """The lookup table as rows (slot, shard)."""
    table = lookup_table(shards, size)
    return df.sparkSession.createDataFrame([(k, shards[i]) for k, i in enumerate(table)], "slot int, shard string"), len(table)


def place(df: DataFrame, key_col: str, shards: Sequence[str], size: int | None = None) -> DataFrame:
    """key_col, slot, shard for each row of df, by a hash join with the broadcast table.

    The table has 100 slots for each shard, so what goes to the executors has a size that is known beforehand. Null keys
    share a shard, equal keys too; an empty table gives an empty result; other columns are not read.
    """
    table, n = _table(df, shards, size)
    keys = df.select(F.col(key_col), slot(F.col(key_col), n).alias("slot"))
    return keys.join(F.broadcast(table), "slot").select(F.col(key_col), "slot", "shard")


def write_shards(df: DataFrame, key_col: str, shards: Sequence[str], path: str, files_per_shard: int = 1) -> None:
    """df's rows under path/shard=NAME. A shard's rows go to several tasks and files, by a hash of all columns' text.

    A null key is like an empty string; repeated rows are each written, and go to one file. A column of df named shard is
    written as _shard (with more underscores if that is taken too); an empty table writes no shard.
    """
    named = df
    for c in df.columns:
        if c == "shard":
            new = "_shard"
            while new in df.columns:
                new = f"_{new}"
            named, key_col = df.withColumnRenamed("shard", new), new if key_col == "shard" else key_col
    at = "_slot"
    while at in named.columns:
        at = f"_{at}"
    table, n = _table(df, shards, None)
    placed = named.withColumn(at, slot(F.col(key_col), n)).join(F.broadcast(table.withColumnRenamed("slot", at)), at).drop(at)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in named.columns)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
