"""Sharding by a lookup table that the shards fill in turn, each by its own order of preference.

Every shard has a permutation of the slots of a table of prime size. The shards take turns; in its
turn a shard claims the first slot of its permutation that is still free. Shares differ by one
slot at most, and a change of the shard list moves few other slots. The table has a fixed size, so
it is broadcast, and a row is placed by one look at the slot of its key's hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

TABLE_SIZE = 65537  # a prime far above the number of shards; it bounds what is broadcast
NO_KEY = "\x00null"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard number of each slot. ``size`` must be a prime not below the number of shards."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("the table size must be prime and hold all shards, whose names must differ")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1)
    table = np.full(size, -1, dtype=np.int64)
    turn = [0] * len(shards)
    claimed = 0
    while True:
        for shard in range(len(shards)):
            while True:  # the size is prime, so the steps visit every slot
                slot = (start[shard] + turn[shard] * skip[shard]) % size
                turn[shard] += 1
                if table[slot] < 0:
                    break
            table[slot] = shard
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: str, size: int):
    """Slot of a row: the first 60 bits of the MD5 of the key's text, modulo the table size."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard`` added.

    Existing columns of these names are kept as ``slot_in`` and ``shard_in``, with more ``_in`` if these names
    are taken too. Rows with a NULL key
    share one slot; rows with equal keys share a slot. Nothing is shuffled: the table of ``size``
    rows is broadcast.
    """
    for name in ("slot", "shard"):
        if name in docs.columns:
            new = name
            while new in docs.columns:
                new += "_in"
            docs = docs.withColumnRenamed(name, new)
    names = [shards[s] for s in fill_table(shards, size)]
    table = docs.sparkSession.createDataFrame(list(enumerate(names)), "slot long, shard string")
    return docs.withColumn("slot", slot_of(key, size)).join(F.broadcast(table), "slot", "left").select(*docs.columns, "slot", "shard")
