"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table (a start and a step, both from a hash of its name).  Shards take turns,
each claiming the first slot of its order that is still free, until the table
is full; so slots are shared evenly, and a change of the shard set moves few of
them.  A row's key hashes to a slot, and a broadcast of the table, whose size
is a parameter, gives the shard.  Rows are placed one by one: no shuffle, and
hot keys do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: largest table; it is filled on the driver and copied to every executor
MOST_SLOTS = 1_000_003
HEX = 15


def hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """Number of the shard that owns each slot.

    ``slots`` must be a prime; with 100 or more slots a shard, the shares
    differ by less than 1 %.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"the number of slots must be a prime from the number of shards up to {MOST_SLOTS}")
    at = [hash60(f"start:{s}") % slots for s in shards]
    step = [hash60(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % slots
        owner[at[s]] = s
    return owner


def table_rows(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The lookup table: (slot, shard)."""
    owner = ",".join(map(str, fill_table(shards, slots)))
    listed = F.split(F.lit(owner), ",").cast("array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(listed).alias("slot", "_s")).select("slot", F.get(names, F.col("_s")).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key; null has the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, HEX), 16, 10).cast("bigint") % slots).cast("int")


def place(docs: DataFrame, key: str, shards: Sequence[str], slots: int) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard`` added.

    Equal keys share a shard.  A column already called ``slot`` or ``shard``
    is replaced; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return rows.join(F.broadcast(table_rows(docs.sparkSession, shards, slots)), "slot").select(*[f"`{c}`" for c in kept], "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard, for readers that open a single one."""
    placed.write.partitionBy("shard").parquet(path)
