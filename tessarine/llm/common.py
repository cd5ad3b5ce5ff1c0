"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing, and the master is a single local process
    (tests), a temporary folder is made and set. A cluster without the setting is an
    error, as a machine-local folder would not be readable by other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tessarine-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends there, so that a lost executor costs a re-read and not a
    recomputation, and every later read prunes columns. ``replaced`` are earlier results
    of this function that nothing reads any more: their files are deleted now. The others
    are deleted when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessarine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessarine_path = path
    _written.append((spark, path))
    for old in replaced:
        gone = getattr(old, "_tessarine_path", None)
        if (spark, gone) in _written:
            _written.remove((spark, gone))
            _delete(spark, gone)
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when the query ends, not when the driver happens to collect its garbage.

    For what :func:`cut` writes: nothing reads the shuffles before it again.
    """
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, queries run with this setting of the session."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Delete what :func:`cut` has written; DataFrames that read it are then unusable."""
    while _written:
        _delete(*_written.pop())


atexit.register(release)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(key: str, names: tuple[str, ...]) -> list[str]:
    """Result columns' ``names``; one that is called like the key column gets underscores."""
    out = []
    for name in names:
        while name.lower() == key.lower():
            name += "_"
        out.append(name)
    return out


#: No more keys than this are ever broadcast as too frequent for one task.
MOST_HOT = 10_000


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], least: int = 100_000) -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row for each key, and the number of the key's rows in __n.

    Keys with more than ``least`` rows that also make up more than 1 / MOST_HOT of all rows, so MOST_HOT at most,
    are broadcast, and their rows stay where they are; the others meet in a shuffle.
    """
    total, largest = facts.agg(F.sum("__n"), F.max("__n")).first()
    bound = max(least, (total or 0) // MOST_HOT)
    if (largest or 0) <= bound:
        return rows.join(facts, keys)
    hot = facts.where(F.col("__n") > bound)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col("__n") <= bound), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def with_facts(rows: DataFrame, keys: list[str], *aggregates: Column, having: str = "true") -> DataFrame:
    """``rows`` with aggregates over all rows of their key, and their number __n, where ``having`` holds.

    What a window partitioned by the keys would give, but combined before the shuffle, so
    that a key that holds a large share of all rows makes no task of that size.
    """
    facts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *aggregates).where(having)
    return lookup(rows, cut(facts), keys)


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def unit_interval(key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, vectorised; ``x`` is uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2**64; kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many spans, by prefix sums of a polynomial.

    Equal spans hash alike wherever they stand; the length goes into the hash.
    """
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    prefix = np.empty(len(codes) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(codes) + 1)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
