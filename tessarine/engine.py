"""The engine: named tables on disk or in memory, SQL statements, searches, views, deletion and compaction."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalar import Scope
from .functions.text import proxy_embedding
from .operators import fusion, lexical, olap
from .plans import nodes as n
from .plans.parser import SqlError, parse
from .plans.planner import Planner, Result, Table
from .sources import fs, readers

#: Declared types and what they are stored as.
TYPES = {
    **dict.fromkeys(("int", "integer", "bigint", "smallint", "tinyint"), "bigint"),
    **dict.fromkeys(("float", "double", "real", "decimal", "numeric"), "double"),
    **dict.fromkeys(("bool", "boolean"), "boolean"),
    "date": "date",
    **dict.fromkeys(("timestamp", "datetime"), "timestamp_ntz"),
    "vector": "array<float>",
}
TEXT_INDEX, VECTOR_INDEX = ("bm25", "sparse", "text"), ("hnsw", "vector", "dense", "ann", "diskann")
#: Files are compacted to about this size.
TARGET_BYTES = 128 << 20
STRATEGIES = {
    **dict.fromkeys(("default", "sparse", "bm25", "text", "distributed"), "bm25"),
    **dict.fromkeys(("dense", "vector", "hnsw", "ann", "diskann", "ivf"), "dense"),
    **{s: s for s in ("splade", "seismic", "hyde", "crag", "graph", "hybrid")},
}


def stored_type(declared: str) -> str:
    return TYPES.get(re.split(r"[(\[]", declared.lower())[0], "string")


class Engine:
    """Tables under ``path`` (or none, with registered DataFrames alone).

    now_ms: the moment that now(), age() and DECAY refer to; the clock's by default.
    compat: SUM and the like of nothing are 0, and aggregates other than COUNT need GROUP BY.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, now_ms: int | None = None, compat: bool = False):
        self.spark, self.path, self.fixed_now, self.compat = spark, path, now_ms, compat
        self.registered: dict[str, Table] = {}

    @property
    def now_ms(self) -> int:
        return self.fixed_now if self.fixed_now is not None else int(time.time() * 1000)

    # tables

    def register(self, name: str, df: DataFrame, id_col: str = "id", text_col: str | None = "text", vec_col: str | None = None, sparse_col: str | None = None, meta_col: str | None = None) -> Table:
        """Make a DataFrame a table of this session; nothing is copied."""
        self.registered[name] = Table(df, id_col, text_col if text_col in df.columns else None, vec_col, sparse_col, meta_col)
        return self.registered[name]

    def at(self, name: str, *more: str) -> str:
        if self.path is None:
            raise SqlError(f"unknown table {name}")
        return "/".join([self.path, "tables", name, *more])

    def meta(self, name: str) -> dict:
        if self.path is None or not fs.exists(self.spark, self.at(name, "table.json")):
            raise SqlError(f"unknown table {name}")
        return fs.read_json(self.spark, self.at(name, "table.json"))

    def save_meta(self, name: str, meta: dict) -> None:
        fs.write_json(self.spark, self.at(name, "table.json"), meta)

    def create_table(self, name: str, columns: list[tuple[str, str]] = (), mode: str = "hybrid") -> str:
        """Does nothing if the table is there."""
        if not fs.exists(self.spark, self.at(name, "table.json")):
            declared = {c: t for c, t in columns if c not in ("id", "text", "embedding", "sparse")}
            vectors = [c for c, t in columns if stored_type(t) == "array<float>"]
            self.save_meta(name, {"mode": mode, "columns": declared, "vector": vectors[0] if vectors else "embedding", "next_id": 0, "parts": [], "indexes": [], "workers": 1})
        return f"table {name} is ready"

    def add(self, name: str, docs: DataFrame | list, **state) -> int:
        """Append documents, numbered from the table's next id; declared columns are cast, bad values become null.

        The rows are written to a folder of their own, which the table has from the moment
        that its description is replaced. ``state`` goes into the same description, so a
        run that breaks off has neither added rows nor noted that it did.
        """
        meta = self.meta(name)
        df = readers.rows(self.spark, docs) if isinstance(docs, list) else docs
        if "id" in df.columns:  # a caller's id is metadata
            df = df.withColumnRenamed("id", "meta_id")
        for c, t in meta["columns"].items():
            kind = stored_type(t)
            if c in df.columns:
                df = df.withColumn(c, F.col(c) if df.schema[c].dataType.simpleString() == kind else Scope(df).value(n.Col(c)).col.try_cast(kind))
            else:
                df = df.withColumn(c, F.lit(None).cast(kind))
        staged = self.at(name, f"staged-{uuid.uuid4().hex}")
        low = F.lit((1 << 33) - 1)
        df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        part = F.shiftright("__row", 33).alias("__part")
        counts = rows.groupBy(part).count()
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written partition
        shift = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
        numbered = rows.withColumn("__part", F.shiftright("__row", 33)).join(F.broadcast(shift), "__part")
        out = numbered.withColumn("id", F.lit(meta["next_id"]) + F.col("__shift") + F.col("__row").bitwiseAND(low)).drop("__part", "__shift", "__row")
        out.select("id", *[c for c in out.columns if c != "id"]).write.parquet(self.at(name, new := f"part-{uuid.uuid4().hex}"))
        added = rows.count()
        fs.delete(self.spark, staged)
        self.save_meta(name, meta | {"next_id": meta["next_id"] + added, "parts": [*meta["parts"], new], "stale": True} | state)
        return added

    @contextmanager
    def bulk(self, name: str) -> Iterator["Engine"]:
        """Add in any number of steps; indexes that the table had are built once, at the end."""
        had = self.meta(name)["indexes"]
        yield self
        if "text" in had:
            self.create_index(name, "bm25")

    def fetch(self, name: str, ids: list[int]) -> DataFrame:
        """Rows by id; the filter reaches the files' statistics."""
        t = self.table(name)
        return t.df.where(F.col(t.id_col).isin(ids))

    def tombstones(self, name: str) -> DataFrame | None:
        at = self.at(name, "tombstones")
        return self.spark.read.parquet(at).distinct() if fs.exists(self.spark, at) else None

    def raw(self, name: str) -> DataFrame:
        """All rows of a table on disk, deleted ones too, with declared types."""
        meta = self.meta(name)
        if not meta["parts"]:
            kinds = "".join(f", `{c}` {stored_type(t)}" for c, t in meta["columns"].items())
            return self.spark.createDataFrame([], f"id bigint, text string{kinds}")
        df = self.spark.read.option("mergeSchema", "true").parquet(*[self.at(name, p) for p in meta["parts"]])
        for c, t in meta["columns"].items():
            if c in df.columns and df.schema[c].dataType.simpleString() != stored_type(t):
                df = df.withColumn(c, F.col(c).try_cast(stored_type(t)))
        return df

    def files(self, name: str) -> list[str]:
        return [f for p in self.meta(name)["parts"] for f in fs.names(self.spark, self.at(name, p)) if f.endswith(".parquet")]

    def table(self, name: str) -> Table:
        if name in self.registered:
            return self.registered[name]
        if self.path is not None and fs.exists(self.spark, self.view_at(name, "view.json")):
            return self.view_table(name)
        meta = self.meta(name)
        df, gone = self.raw(name), self.tombstones(name)
        if gone is not None:
            df = df.join(gone, "id", "left_anti")
        have = lambda c: c if c in df.columns else None
        index = self.at(name, "index", "text") if "text" in meta["indexes"] and not meta.get("stale") else None
        return Table(df, "id", have("text"), have(meta["vector"]), have("sparse"), have("metadata"), index, unique=True)

    def delete(self, name: str, ids: list[int]) -> int:
        """Mark ids as deleted; counts those that were there."""
        there = self.table(name).df.where(F.col("id").isin(ids)).select("id")
        found = there.count()
        if found:
            there.write.mode("append").parquet(self.at(name, "tombstones"))
            self.save_meta(name, self.meta(name) | {"stale": True})
        return found

    def compact(self, name: str, full: bool = False) -> str:
        """Rewrite the table without deleted rows, into files of about the target size.

        The new files are complete before the table refers to them. Without ``full``
        a table that has neither deletions nor many small files is left as it is.
        """
        meta = self.meta(name)
        old = [self.at(name, p) for p in meta["parts"]]
        files = self.files(name)
        if not files:
            return f"table {name} is empty"
        if not full and self.tombstones(name) is None and len(files) < 4:
            return f"table {name} needs no compaction"
        parts = max(1, -(-sum(fs.size(self.spark, at) for at in old) // TARGET_BYTES))
        new = f"part-{uuid.uuid4().hex}"
        self.table(name).df.repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(self.at(name, new))
        self.save_meta(name, meta | {"parts": [new]})
        for at in [self.at(name, "tombstones"), *old]:
            fs.delete(self.spark, at)
        return f"table {name} is compacted into {parts} files"

    def alter_type(self, name: str, column: str, declared: str, rewrite: bool = False) -> str:
        meta = self.meta(name)
        meta["columns"] = meta["columns"] | {column: declared}
        self.save_meta(name, meta)
        return self.compact(name, full=True) if rewrite else f"{name}.{column} is {declared}"

    def create_index(self, table: str, method: str) -> str:
        if method not in (*TEXT_INDEX, *VECTOR_INDEX, "hybrid"):
            raise SqlError(f"unknown index method {method}")
        meta = self.meta(table)
        source = self.table(table)
        if source.df.isEmpty():
            raise SqlError(f"table {table} is empty")
        if method in TEXT_INDEX or method == "hybrid":
            lexical.build_index(source.df, self.at(table, "index", "text"), "id", "text")
            meta["indexes"] = sorted({*meta["indexes"], "text"})
            meta["stale"] = False
        if method in VECTOR_INDEX or method == "hybrid":
            meta["indexes"] = sorted({*meta["indexes"], "vector"})  # answered by the exact scan
        self.save_meta(table, meta)
        return f"index on {table} using {method} is built"

    def drop_table(self, name: str) -> str:
        if self.registered.pop(name, None) is None:
            self.meta(name)
            fs.delete(self.spark, self.at(name))
        return f"table {name} is dropped"

    def names(self) -> list[str]:
        on_disk = fs.names(self.spark, f"{self.path}/tables") if self.path else []
        return sorted({*self.registered, *on_disk})

    def describe(self, name: str) -> DataFrame:
        """(property, value)"""
        t = self.table(name)
        facts = [("rows", str(t.df.count())), *((f"column {c}", kind) for c, kind in t.df.dtypes)]
        if name not in self.registered:
            meta = self.meta(name)
            files = self.files(name)
            facts += [("mode", meta["mode"]), ("files", str(len(files))), ("workers", str(meta["workers"])), ("indexes", ",".join(meta["indexes"]) or "none")]
        return self.spark.createDataFrame(facts, "property string, value string")

    def show_create(self, name: str) -> str:
        meta = self.meta(name)
        columns = ", ".join(f"{c} {t}" for c, t in meta["columns"].items())
        return f"CREATE TABLE {name}{f' ({columns})' if columns else ''} USING {meta['mode']}"

    # views

    def view_at(self, name: str, *more: str) -> str:
        return "/".join([str(self.path), "views", name, *more])

    def create_view(self, name: str, text: str) -> str:
        """Store a search's (id, score, rank) rows with its whole text, from which refreshing runs it again."""
        q = parse(text)
        if q.aggregates or not q.searches:
            raise SqlError("a materialized view holds a search")
        q.items = [n.Item(n.Col("id")), n.Item(n.Col("score"))]
        hits = self.planner().plan(q).df
        new = f"data-{uuid.uuid4().hex}"
        fusion.ranked(hits, "id").write.parquet(self.view_at(name, new))
        old = fs.read_json(self.spark, self.view_at(name, "view.json"))["data"] if fs.exists(self.spark, self.view_at(name, "view.json")) else None
        fs.write_json(self.spark, self.view_at(name, "view.json"), {"query": text, "table": q.table, "data": new})
        if old:
            fs.delete(self.spark, self.view_at(name, old))
        return f"view {name} is stored"

    def refresh_view(self, name: str) -> str:
        return self.create_view(name, self.view(name)["query"])

    def view(self, name: str) -> dict:
        if not fs.exists(self.spark, self.view_at(name, "view.json")):
            raise SqlError(f"unknown view {name}")
        return fs.read_json(self.spark, self.view_at(name, "view.json"))

    def view_table(self, name: str) -> Table:
        view = self.view(name)
        rows = self.spark.read.parquet(self.view_at(name, view["data"])).select("id", "score", "rank")
        base = self.table(view["table"])
        df = base.df.join(rows.withColumnRenamed("id", base.id_col), base.id_col)
        return Table(df, base.id_col, base.text_col, base.vec_col, base.sparse_col, base.meta_col)

    def views(self) -> list[str]:
        return fs.names(self.spark, f"{self.path}/views") if self.path else []

    # statements

    def planner(self) -> Planner:
        return Planner(self.table, self.now_ms, self.compat)

    def sql(self, text: str) -> Result:
        """Run a statement. Searches, scans and aggregations are lazy; what changes tables is done at once."""
        s = parse(text)
        if isinstance(s, n.Select):
            if s.explain:
                return self.explained(s)
            if self.is_view(s.table):
                if s.searches or s.group_by:
                    raise SqlError("a materialized view takes neither a search nor GROUP BY")
                s.order_by = s.order_by or [(n.Col("score"), True)]
            return self.planner().plan(s)
        if isinstance(s, n.CreateTable):
            return self.message(self.create_table(s.name, s.columns, s.mode))
        if isinstance(s, n.CreateIndex):
            return self.message(self.create_index(s.table, s.method))
        if isinstance(s, n.CreateView):
            return self.message(self.create_view(s.name, s.text))
        if isinstance(s, n.AlterType):
            return self.message(self.alter_type(s.table, s.column, s.type, s.rewrite))
        if isinstance(s, n.AlterWorkers):
            self.save_meta(s.table, self.meta(s.table) | {"workers": s.workers})
            return self.message(f"table {s.table} has {s.workers} workers")
        if isinstance(s, n.Delete):
            return self.message(f"{self.delete(s.table, s.ids)} rows deleted")
        return self.command(s)

    def command(self, s: n.Command) -> Result:
        if s.verb == "show_tables":
            rows = [(x, self.table(x).df.count()) for x in self.names()]
            return Result(self.spark.createDataFrame(rows, "table string, rows bigint"))
        if s.verb == "show_indexes":
            return Result(self.spark.createDataFrame([(x,) for x in self.meta(s.name)["indexes"]], "index string"))
        if s.verb == "show_views":
            return Result(self.spark.createDataFrame([(x,) for x in self.views()], "view string"))
        if s.verb == "describe":
            return Result(self.describe(s.name))
        if s.verb == "drop_view":
            self.view(s.name)
            fs.delete(self.spark, self.view_at(s.name))
            return self.message(f"view {s.name} is dropped")
        done = {"drop_table": self.drop_table, "compact": self.compact, "compact_full": lambda x: self.compact(x, True), "show_create": self.show_create, "refresh_view": self.refresh_view}
        return self.message(done[s.verb](s.name))

    def message(self, text: str) -> Result:
        return Result(self.spark.createDataFrame([(text,)], "message string"))

    def is_view(self, name: str) -> bool:
        return self.path is not None and name not in self.registered and name in self.views()

    def explained(self, q: n.Select) -> Result:
        """A line that names the kind of plan; for searches also the result and its stages."""
        q.explain = False
        result = self.planner().plan(q)
        facts = f"table={q.table} limit={q.limit} offset={q.offset}"
        if self.is_view(q.table):
            kind = "MaterializedViewScan"
        elif q.aggregates:
            trivial = not q.group_by and q.where is None and not q.searches
            kind, facts = ("TrivialCountScan", f"table={q.table}") if trivial else ("AggregateScan", facts + f" group_by={[n.label(e) for e in q.group_by]}")
        elif q.searches:
            kind = "RetrievalScan"
            facts += f" lexical={q.lexical.method if q.lexical else None} dense={q.dense is not None} hyde={q.hyde} crag={q.crag} graph={q.graph_depth} fusion_k={q.fusion_k}"
        else:
            from .plans.parser import ids_of

            mode = "id_lookup" if q.where is not None and ids_of(q.where) is not None else "full"
            kind, facts = "TableScan", facts + f" mode={mode} distinct={q.distinct}"
        result.explain_text = f"{kind}({facts})"
        return result if q.searches else Result(self.message(result.explain_text).df, explain_text=result.explain_text)

    def search(self, table: str, query: str = "", top_k: int = 10, offset: int = 0, strategy: str = "default", query_vector: list[float] | None = None, sparse: dict[str, float] | None = None, where: str | None = None, facets: list[str] = (), facet_top_n: int = 20, k1: float | None = None, b: float | None = None, boosts: dict[str, float] | None = None, decay: tuple[str, float] | None = None, highlight: bool = False, snippet_len: int = 160, depth: int = 1, graph_expand: bool = False, rescore: bool = False, log: str | None = None) -> Result:
        """The builder's counterpart of a search statement; ``where`` is a predicate in SQL."""
        if strategy not in STRATEGIES:
            raise SqlError(f"unknown strategy {strategy}")
        kind = STRATEGIES[strategy]
        q = n.Select(table, limit=top_k, offset=offset, facets=list(facets), facet_limit=facet_top_n, boosts=list((boosts or {}).items()), decay=decay, rescore=rescore)
        conditions = [parse(f"SELECT * FROM {table} WHERE {where}").where] if where else []
        query, present = self.inline_filters(table, query, conditions)
        q.where = n.And(tuple(conditions)) if conditions else None
        if present:  # "#key": the row has that metadata
            t = self.table(table)
            q.table = f"{table}#"
            self.registered[q.table] = replace(t, df=t.df.where(olap.tagged(t.df, t.scope(self.now_ms), present)), index=None)
        if kind != "dense":
            q.lexical = n.Lexical(query, kind if kind in ("splade", "seismic") else "bm25", k1=k1, b=b, weights=sparse)
        if kind in ("dense", "hybrid") or (query_vector is not None and kind == "bm25" and strategy == "default"):
            q.dense = n.Dense(query_vector, None if query_vector is not None else query)
        q.hyde, q.crag = kind == "hyde", kind == "crag"
        q.graph_depth = depth if graph_expand or kind == "graph" else 0
        q.highlight = snippet_len if highlight else None
        result = self.planner().plan(q)
        if log:
            line = {"table": table, "query": query, "strategy": strategy, "top_k": top_k, "at": self.now_ms}
            result.df.select(F.col(self.table(table).id_col).alias("id"), "score").agg(F.collect_list(F.struct("id", "score")).alias("hits")).select(*[F.lit(v).alias(k) for k, v in line.items()], "hits").write.mode("append").json(log)
        return result

    def inline_filters(self, table: str, query: str, conditions: list) -> tuple[str, list[str]]:
        """Takes ``field:value`` of known fields, and ``#field``, out of a query's text: (the rest, fields that must be there)."""
        t, rest, present = self.table(table), [], []
        known = {c.lower() for c in t.df.columns}
        for word in query.split():
            name, colon, value = word.partition(":")
            if colon and value and (name.lower() in known or t.meta_col):
                conditions.append(n.Cmp(n.Col(name.lower()), "=", value))
            elif word.startswith("#") and word[1:].isidentifier() and (word[1:].lower() in known or t.meta_col):
                present.append(word[1:].lower())
            else:
                rest.append(word)
        return " ".join(rest), present

    def searches(self, log: str, last: int = 100) -> DataFrame:
        """The last entries of a search log."""
        return self.spark.read.json(log).orderBy(F.desc("at")).limit(last)

    def with_proxy_vectors(self, name: str, dim: int = 64) -> Table:
        """The table with hashed vectors of its texts where it has no vector column."""
        t = self.table(name)
        if t.vec_col:
            return t
        return self.register(name, t.df.withColumn("embedding", proxy_embedding(F.col(t.text_col), dim)), t.id_col, t.text_col, "embedding", t.sparse_col, t.meta_col)
