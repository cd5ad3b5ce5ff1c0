"""Packing by concatenate-and-cut.

All documents, in the order of their ids, form one stream of tokens, which is cut into
windows of ``length`` tokens; the last may be shorter. A token is a maximal run of
bytes other than the six ASCII white-space bytes.

Global offsets come from two-pass prefix sums. The first pass counts tokens per
document, and sums them up per id range; the totals of the ranges, a table with one row
per range, are prefix-summed. In the second pass each range numbers its own tokens from
its offset. Only that pass moves texts, once.

The result has one row for each piece of a document in a window, the boundary records:
``window_id, window_start, window_end, doc_id, doc_start, doc_end, text`` with half-open
token spans; the text's tokens are joined by single spaces. The pieces of a window,
in the order of window_start, tile it without gaps.

Defined results
---------------
* null or empty texts, and texts of white space only, have no tokens and no rows.
* null ids come first in the stream, in the order of their texts; they stay null.
* repeated ids follow each other in the order of their texts; equal rows are all packed.
* a document longer than a window spans as many windows as it needs.
* an empty table gives an empty result; extra columns are ignored.
* ids are numbers, dates or timestamps (ranges of them are cut at percentiles); others
  raise TypeError. Rows of one id, or without one, are streamed through one task each,
  in sorted order; none is held in memory.
* very long texts are cut like others. A result column called like the id column gets
  an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, NumericType, TimestampNTZType, TimestampType

from .common import named, type_of


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


@F.pandas_udf(LongType())
def _count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(t.encode("utf-8", "surrogatepass").split()) if t else 0).astype("int64")


def _cut_points(ids: DataFrame, ranges: int) -> list:
    """Ids that split the table into ranges of about equal numbers of documents."""
    probs = [i / ranges for i in range(1, ranges)]
    return sorted(set(ids.agg(F.percentile_approx("__id", F.lit(probs), 10000)).first()[0] or []))


def _range_of(key: Column, points: list) -> Column:
    """How many of the sorted points are below the key: first among every 64th, then among the 64 that follow; 0 for null."""
    step = 64

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda p: p < key))

    coarse = below(F.array(*[F.lit(p) for p in points[step - 1 :: step]])) if len(points) >= step else F.lit(0)
    start = coarse * F.lit(step)
    return F.when(key.isNull(), 0).otherwise(start + below(F.slice(F.array(*[F.lit(p) for p in points]), start + 1, step)))


def pack(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The boundary records of all windows.

    ranges: the number of id ranges; the session's shuffle partitions by default. The
    result does not depend on it.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = type_of(docs, id_col)
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise TypeError("ids must be numbers, dates or timestamps")
    epoch = F.lit(0) if isinstance(kind, NumericType) else F.lit("1970-01-01")
    names = named(id_col, ("window_id", "window_start", "window_end", "doc_start", "doc_end", "text"))
    columns = [*names[:3], id_col, *names[3:]]
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > 0)

    points = _cut_points(base.select("__id"), ranges) if ranges > 1 else []
    ranged = base.withColumn("__range", (_range_of(F.col("__id"), points) if points else F.lit(0)).cast("int"))

    totals = ranged.select("__range", _count("__text").alias("__n")).groupBy("__range").agg(F.sum("__n").alias("__total")).collect()
    offsets, running = {}, 0
    for row in sorted(totals, key=lambda r: r["__range"]):
        offsets[row["__range"]] = running
        running += row["__total"]
    table = F.create_map(*[F.lit(x) for k, v in offsets.items() for x in (k, v)]) if offsets else None
    start = F.element_at(table, F.col("__range")) if offsets else F.lit(0)

    parts = len(points) + 1
    placed = ranged.repartitionById(parts, F.col("__range")).sortWithinPartitions("__range", F.col("__id").asc_nulls_first(), "__text")
    placed = placed.select("__range", start.cast("long").alias("__start"), F.coalesce("__id", epoch.cast(id_type)).alias("__id"), F.col("__id").isNull().alias("__null"), "__text")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, offset = None, 0
        for batch in batches:
            rows = {k: [] for k in columns}
            for where, first, key, null, text in zip(batch["__range"], batch["__start"], batch["__id"], batch["__null"], batch["__text"]):
                if where != here:
                    here, offset = where, int(first)
                tokens = tokens_of(text)
                done = 0
                while done < len(tokens):
                    window, inside = divmod(offset, length)
                    take = min(length - inside, len(tokens) - done)
                    for name, value in zip(rows, (window, inside, inside + take, None if null else key, done, done + take, b" ".join(tokens[done : done + take]).decode("utf-8", "replace"))):
                        rows[name].append(value)
                    done += take
                    offset += take
            yield pd.DataFrame({k: pd.Series(v, dtype=object if k in (id_col, columns[-1]) else "int64") for k, v in rows.items()})

    kinds = ("long", "long", "long", id_type, "long", "long", "string")
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds))
    return placed.mapInPandas(windows, schema)
