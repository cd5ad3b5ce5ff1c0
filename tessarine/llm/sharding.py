"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone: no ring table, no
state. When shards are appended, a key either stays or moves to one of the new shards,
so that only the fraction (new - old) / new moves.

The key is turned into 60 bits of its MD5 digest in the JVM, so the result does not
depend on the language that computes it; the jumps run vectorised over Arrow batches,
all keys of a batch together, about ln(n_shards) + 2 rounds.

Defined results
---------------
* null key: shard 0 (it hashes as the empty string does not; it is a rule of its own).
* empty strings are keys like any other; very long keys cost their MD5 only.
* repeated keys get the same shard; ties do not exist.
* an empty table gives an empty result.
* an existing column named like the result column is replaced.
* n_shards < 1 raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards of many 64-bit keys (Lamping and Veach, 2014)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * _STEP + np.uint64(1)
        low = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((shard[live] + 1) * (float(1 << 31) / low)).astype(np.int64)
        inside = jump < n_shards
        live = live[inside]
        shard[live] = jump[inside]
    return shard


def stable_key(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of the key as a string."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard of a key, 0 .. n_shards-1; null keys are in shard 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    @F.pandas_udf("int")
    def jump(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            known = keys.notna().to_numpy()
            shard = np.zeros(len(keys), dtype=np.int32)
            shard[known] = jump_hash(keys[known].to_numpy(dtype=np.int64), n_shards)
            yield pd.Series(shard)

    return jump(stable_key(key))


def assign(df: DataFrame, n_shards: int, key_col: str = "doc_id", out_col: str = "shard", together: bool = True) -> DataFrame:
    """``df`` with its shard; with ``together``, each shard's rows are in one partition.

    A later ``write.partitionBy(out_col)`` then makes one file per shard. The rows go
    there by partition id, so no two shards share a partition by accident.
    """
    out = df.withColumn(out_col, shard_of(F.col(key_col), n_shards))
    return out.repartitionById(n_shards, F.col(out_col)) if together else out


def moved(df: DataFrame, before: int, after: int, key_col: str = "doc_id") -> DataFrame:
    """The rows (key, shard_before, shard_after) that a change of the number of shards moves."""
    key = F.col(key_col)
    both = df.select(key, shard_of(key, before).alias("shard_before"), shard_of(key, after).alias("shard_after"))
    return both.where("shard_before <> shard_after")
