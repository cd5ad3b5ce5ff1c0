"""Batch sources. Each returns a DataFrame with ``text`` and whatever else the source has."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import vector_literal

TEXT_FIELDS = ("text", "passage", "content")


def parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def jsonl(spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType | str | None = None, keep_fields: bool = True) -> DataFrame:
    """One object a line; the first of text, passage and content is the text; lines without one are left out."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(path)
    have = [c for c in TEXT_FIELDS if c in df.columns]
    text = F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("string")
    rest = [F.col(c) for c in df.columns if c not in TEXT_FIELDS and not c.startswith("_corrupt")] if keep_fields else []
    df = df.select(text.alias("text"), *rest).where(F.length(F.trim("text")) > 0)
    return df if limit is None else df.limit(limit)


def text_file(spark: SparkSession, path: str, chunk_by: str = "paragraph") -> DataFrame:
    """Chunks of text files: lines, or paragraphs between blank lines; trimmed, empty ones dropped."""
    if chunk_by not in ("paragraph", "line"):
        raise ValueError("chunk_by is paragraph or line")
    if chunk_by == "line":
        return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    # the reader splits at blank lines, so that no file has to be held whole
    each = spark.read.option("lineSep", "\n\n").text(path)
    return each.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def rows(spark: SparkSession, docs: Iterable[str | dict]) -> DataFrame:
    """Strings or dictionaries; ``vector``/``embedding`` and ``sparse`` are typed, other values become their JSON types."""
    out, names = [], {"text": "string"}
    for d in docs:
        d = {"text": d} if isinstance(d, str) else dict(d)
        if "vector" in d:
            d["embedding"] = d.pop("vector")
        out.append(d)
        for k, v in d.items():
            if k in ("embedding", "sparse"):
                names[k] = "array<float>" if k == "embedding" else "map<string,float>"
            elif v is not None:
                kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
                names[k] = kind if names.get(k, kind) == kind else "double" if {names[k], kind} == {"bigint", "double"} else "string"
    cast = {"bigint": int, "double": float, "string": str, "boolean": bool}

    def value(k: str, v):
        if v is None:
            return None
        if k == "embedding":
            return [float(x) for x in v]
        if k == "sparse":
            return {str(a): float(b) for a, b in v.items()}
        return cast[names[k]](v)

    return spark.createDataFrame([tuple(value(k, d.get(k)) for k in names) for d in out], ", ".join(f"`{k}` {t}" for k, t in names.items()))


def pandas_frame(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(frame)


def arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table; the text is the column of that name, else the first of strings; empty texts are left out, nulls an error."""
    df = spark.createDataFrame(table)
    if "text" not in df.columns:
        first = next((f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)), None)
        if first is None:
            raise ValueError("the table has no column of strings")
        df = df.withColumnRenamed(first, "text")
    checked = F.when(F.col("text").isNull(), F.raise_error(F.lit("a text is null"))).otherwise(F.col("text"))
    return df.withColumn("text", checked).where(F.length("text") > 0)


def jdbc(spark: SparkSession, url: str, query: str, cursor: str | None = None, after=None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's rows, after a cursor value if one is given; partition is (column, low, high, parts)."""
    where = ""
    if cursor is not None and after is not None:
        literal = str(after) if isinstance(after, (int, float)) else "'" + str(after).replace("'", "''") + "'"
        where = f" WHERE {cursor} > {literal}"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"(SELECT * FROM ({query}) q{where}) t").options(**options)
    if partition:
        for key, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
            reader = reader.option(key, v)
    return reader.load()


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of a source's columns."""
    return df.dtypes


@dataclass(frozen=True)
class Mapping:
    """Which columns are what. No metadata columns, or ``*``: all but the text."""

    text_column: str
    metadata_columns: list[str] = field(default_factory=list)
    vector_column: str | None = None
    id_column: str | None = None
    cursor_column: str | None = None


def mapped(df: DataFrame, m: Mapping) -> DataFrame:
    """``text``, the metadata columns with their types, and ``embedding`` from an array or its text."""
    every = not m.metadata_columns or "*" in m.metadata_columns
    keep = [c for c in df.columns if c != m.text_column and c != m.vector_column and (every or c in m.metadata_columns)]
    out = [F.col(m.text_column).cast("string").alias("text"), *[F.col(c) for c in keep if c not in ("text", "embedding")]]
    if m.vector_column:
        v = F.col(m.vector_column)
        out.append((v.cast("array<float>") if isinstance(df.schema[m.vector_column].dataType, T.ArrayType) else vector_literal(v)).alias("embedding"))
    if m.cursor_column and m.cursor_column not in keep:
        out.append(F.col(m.cursor_column))
    return df.select(*out)


class _Pages(InputPartition):
    def __init__(self, offset: int, stop: int | None):
        self.offset, self.stop = offset, stop


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, schema.names

    def partitions(self) -> list[InputPartition]:
        total, parts = self.options.get("total"), int(self.options.get("parts", 1))
        if total is None:
            return [_Pages(0, None)]
        step = -(-int(total) // parts)
        return [_Pages(a, min(a + step, int(total))) for a in range(0, int(total), max(step, 1))]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        size, at = int(self.options.get("pagesize", 500)), partition.offset
        while partition.stop is None or at < partition.stop:
            n = size if partition.stop is None else min(size, partition.stop - at)
            found = fetch(self.options["url"], self.options.get("recordskey"), n, at)
            for record in found:
                yield tuple(_as_text(record.get(k)) for k in self.names)
            at += len(found)
            if len(found) < n:
                return


def _as_text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def fetch(url: str, records_key: str | None, limit: int, offset: int) -> list[dict]:
    """One page of a JSON service that takes limit and offset."""
    with urllib.request.urlopen(f"{url}{'&' if '?' in url else '?'}limit={limit}&offset={offset}", timeout=60) as answer:
        body = json.load(answer)
    records = body.get(records_key) if records_key else body
    if not isinstance(records, list):
        raise ValueError("the response holds no array of records")
    return [r for r in records if isinstance(r, dict)]


class HttpSource(DataSource):
    """``spark.read.format("http_json").option("url", ...)``: pages of records, values as text, nested ones as JSON.

    Options: url, recordsKey, pageSize; total and parts read ranges of offsets in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> T.StructType:
        first = fetch(self.options["url"], self.options.get("recordskey"), 1, 0)
        return T.StructType([T.StructField(k, T.StringType()) for k in (first[0] if first else {})])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(dict(self.options), schema)


def http_json(spark: SparkSession, url: str, records_key: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(HttpSource)
    reader = spark.read.format("http_json").option("url", url)
    if records_key:
        reader = reader.option("recordsKey", records_key)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
