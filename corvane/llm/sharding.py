"""Consistent placement through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size
(offset and skip from hashes of its name); the shards take turns, each claiming
the first free slot it prefers, until the table is full. A key's shard is the
owner of slot hash(key) mod size. The table has `size` rows whatever the data,
so broadcasting it is bounded, and placing a row is one hash and one probe, with
no shuffle.

Edge cases: a null key is placed as the empty string, repeated rows go to the
same shard, an empty table gives no rows; key columns are read by name only and
the added columns overwrite columns of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_048_583


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner (index in shards) of each slot."""
    if size < 2 or size > MAX_TABLE_SIZE or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime of at most {MAX_TABLE_SIZE}")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards must be 1 to size distinct names")
    at = [_hash("offset:" + s) % size for s in shards]
    skip = [_hash("skip:" + s) % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    filled = 0
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            filled += 1
            if filled == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def place(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with its slot (long) and shard (string)."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("pos", "owner"))
    table = table.select(F.col("pos").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], slot_of(key, size).alias("slot"))
    return placed.join(F.broadcast(table), "slot")
