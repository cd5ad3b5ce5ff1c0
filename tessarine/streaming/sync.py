"""Keeping a table in step with a source: full and incremental synchronisation, batch or streaming.

Cursors are compared by their type, never as text. A streaming run is incremental by
its checkpoint: every micro-batch is appended once, as batch ids that were already
committed are passed over. A table's rows and the cursor or batch that they reach to are
committed in one step (see Engine.add): a run that fails in between leaves neither.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.lexical import document_frequencies
from ..sources.readers import Mapping, mapped


@dataclass
class Run:
    rows: int
    cursor: object = None


def full_sync(engine: Engine, table: str, source: DataFrame, mapping: Mapping, replace: bool = True, compact: bool = True) -> Run:
    """Load the whole source; with ``replace`` in place of what the table had."""
    if replace and table in engine.names():
        engine.drop_table(table)
    engine.create_table(table)
    rows = engine.add(table, mapped(source, mapping))
    if compact and rows:
        engine.compact(table, full=True)
    return Run(rows)


def incremental_sync(engine: Engine, table: str, source: DataFrame, mapping: Mapping, limit: int | None = None) -> Run:
    """Append rows whose cursor is beyond the last run's.

    limit: about how many rows a run takes; all rows that tie with the last cursor value
    come along, so that none is left behind. Rows with a null cursor are never taken.
    """
    if not mapping.cursor_column:
        raise ValueError("an incremental run needs a cursor column")
    engine.create_table(table)
    last_cursor = engine.meta(table).get("cursor")
    kind = source.schema[mapping.cursor_column].dataType.simpleString()
    cursor = F.col(mapping.cursor_column)
    new = source.where(cursor.isNotNull())
    if last_cursor is not None:
        new = new.where(cursor > F.lit(last_cursor).cast(kind))
    if limit is not None:
        last = new.select(cursor.alias("c")).orderBy("c").limit(limit).agg(F.max("c")).first()[0]
        if last is not None:
            new = new.where(cursor <= F.lit(last).cast(kind))
    top = new.agg(F.max(cursor).cast("string")).first()[0]
    if top is None:
        return Run(0, last_cursor)
    # the batch ends at a known value: rows that arrive meanwhile wait for the next run
    return Run(engine.add(table, mapped(new.where(cursor <= F.lit(top).cast(kind)), mapping), cursor=top), top)


def stream_sync(engine: Engine, table: str, stream: DataFrame, mapping: Mapping, checkpoint: str, every: str | None = None, frequencies: str | None = None) -> StreamingQuery:
    """Append a stream's micro-batches; ``every`` is the trigger's interval, without it all that is there is taken once.

    frequencies: a folder for the (term, df) table of each batch; :func:`merge_frequencies`
    of them is the corpus's.
    """
    engine.create_table(table)

    def append(batch: DataFrame, batch_id: int) -> None:
        meta = engine.meta(table)
        if batch_id <= meta.get("last_batch", -1):
            return
        rows = mapped(batch, mapping)
        if frequencies:
            document_frequencies(rows).write.mode("overwrite").parquet(f"{frequencies}/batch={batch_id}")
        engine.add(table, rows, last_batch=batch_id)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def frequencies_of(engine: Engine, path: str) -> DataFrame:
    """The merged (term, df) table of a stream's batches."""
    return engine.spark.read.parquet(path).groupBy("term").agg(F.sum("df").alias("df"))
