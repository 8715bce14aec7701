"""Consistent placement of rows on shards with a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size, and the shards take
turns claiming the first slot of their order that is still free. A key's hash names a slot, the slot names
the shard. When shards come or go, few slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.shared import MAX_BROADCAST_BYTES, free_name

#: Slots of the table: prime, and at least a hundred for each shard to be even within a percent.
SLOTS = 65_537
#: The largest table; it bounds what is broadcast to about 16 MB.
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that holds each slot. A shard of weight w claims w slots in its turn."""
    if not _is_prime(slots) or slots > MAX_SLOTS or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("the number of slots must be prime, bounded and not below that of the distinct shards")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard needs a weight of 1 at least")
    at, skip = [], []
    for name in shards:
        h = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        skip.append(int.from_bytes(h[8:], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while True:
        for i, w in enumerate(turns):
            for _ in range(w):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table size. Null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def table_rows(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """The lookup table as (slot, shard): exactly `slots` rows."""
    table = lookup_table(shards, slots, weights)
    n_bytes = sum(8 + len(shards[i].encode()) for i in table)
    if n_bytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"a table of {n_bytes} bytes exceeds {MAX_BROADCAST_BYTES}: use fewer slots or shorter names")
    return spark.createDataFrame(pd.DataFrame({"slot": range(slots), "shard": [shards[i] for i in table]}), "slot long, shard string")


def assign_shards(
    df: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, weights: Sequence[int] | None = None,
    salt: str | None = None, spread: int = 1, slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """Add the slot and the shard of each row's key.

    Equal keys share a shard, null keys that of the empty text. Where one key may have a large share of the
    rows, `salt` names a column whose hash deals each key over `spread` sub-keys, the first of which is the
    key itself. Rows and other columns stay; columns of the two names are replaced; an empty table stays
    empty. The table of `slots` rows is broadcast, so nothing is shuffled.
    """
    name = F.col(f"`{key}`").cast("string")
    if salt is not None and spread > 1:
        part = F.pmod(F.xxhash64(F.col(f"`{salt}`")), F.lit(spread))
        name = F.when(part == 0, name).otherwise(F.concat_ws("#", F.coalesce(name, F.lit("")), part.cast("string")))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot.lower(), shard.lower())]
    own = free_name(df, "_slot")
    placed = df.select(*kept, slot_of(name, slots).alias(own))
    table = table_rows(df.sparkSession, shards, slots, weights).toDF(slot, shard)
    return placed.join(F.broadcast(table), F.col(own) == F.col(f"`{slot}`")).drop(own)


def write_shards(df: DataFrame, path: str, files: int = 1, **options) -> None:
    """Write df as Parquet, one folder for each shard; rows of a shard are dealt over `files` tasks by their content."""
    placed = assign_shards(df, **options)
    shard = options.get("shard", "shard")
    file = free_name(placed, "_file")
    dealt = placed.withColumn(file, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(files)))
    dealt.repartition(F.col(f"`{shard}`"), F.col(file)).drop(file).write.partitionBy(shard).parquet(path)
