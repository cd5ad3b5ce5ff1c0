"""Small files through Hadoop's file systems, so that paths may be local, HDFS or object stores."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _of(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _of(spark, path)
    return fs.delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _of(spark, source)
    if not fs.rename(at, _of(spark, target)[1]):
        raise OSError(f"cannot rename {source} to {target}")


def size(spark: SparkSession, path: str) -> int:
    """The bytes of all files below a folder."""
    fs, at = _of(spark, path)
    return fs.getContentSummary(at).getLength()


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_json(spark: SparkSession, path: str):
    fs, at = _of(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Written beside and renamed, so that a reader never sees half a file."""
    fs, at = _of(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(beside, at, over)
