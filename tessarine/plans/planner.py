"""From a :class:`Select` to DataFrames.

Filters and semi-joins come before ranking. A score is a column of the row it belongs to,
so rows are told apart even where their ids are equal, and what is shown is read in the
same scan. Only where lists are fused, or come from an index, rows meet again by a key:
the id where it is unique, or else the id with a digest of the whole row. Facets and
DISTINCT see all matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import Scope
from ..functions.text import hashed_vector, highlight, tokens_of
from ..operators import dense, fusion, lexical, olap
from . import nodes as n
from .parser import SqlError

ROW = "__row"


@dataclass
class Table:
    """A DataFrame and the roles of its columns; names that it lacks mean that there is no such role."""

    df: DataFrame
    id_col: str = "id"
    text_col: str | None = "text"
    vec_col: str | None = None
    sparse_col: str | None = None
    meta_col: str | None = None
    index: str | None = None
    unique: bool | None = None  # whether ids are; None: not looked at yet

    def has_unique_ids(self) -> bool:
        if self.unique is None:
            self.unique = self.df.groupBy(self.id_col).count().where("count > 1").isEmpty()
        return self.unique

    def scope(self, now_ms: int) -> Scope:
        return Scope(self.df, self.id_col, self.text_col, self.meta_col, now_ms)


@dataclass
class Result:
    """df: the page. facets: (field, value, count, rank) or None. stages: (name, rows) for the provenance."""

    df: DataFrame
    facets: DataFrame | None = None
    explain_text: str | None = None
    stages: list[tuple[str, DataFrame]] = field(default_factory=list)
    id_col: str = "id"

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_dict(self) -> dict[str, list]:
        table = self.df.toArrow()
        return table.to_pydict()

    def facet_counts(self) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list[tuple[str, int]]] = {}
        for r in self.facets.orderBy("field", "rank").collect() if self.facets is not None else []:
            out.setdefault(r["field"], []).append((r["value"], r["count"]))
        return out

    def pages(self):
        """Rows one after another, without holding the result on the driver."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def provenance(self) -> DataFrame:
        return fusion.provenance(self.stages, self.id_col)


class Planner:
    """tables: finds a :class:`Table` by name; now_ms: what now() and ages refer to."""

    def __init__(self, tables, now_ms: int, compat: bool = False):
        self.tables, self.now_ms, self.compat = tables, now_ms, compat

    def plan(self, q: n.Select, ctes: dict[str, n.Select] | None = None) -> Result:
        ctes = {**(ctes or {}), **q.ctes}
        base = self.table(q.table, ctes)
        scope = base.scope(self.now_ms)
        docs = base.df
        if q.where is not None:
            docs = docs.where(scope.predicate(q.where))
        for join in q.joins:
            right = self.table(join.table, ctes)
            docs = olap.semi_join(docs, right.df, scope(join.left_key).col, right.scope(self.now_ms)(join.right_key).col)
        if q.aggregates:
            return self.aggregated(q, base, scope, docs)
        if q.searches:
            return self.search(q, base, scope, docs)
        return self.scan(q, base, scope, docs)

    def table(self, name: str, ctes: dict[str, n.Select]) -> Table:
        if name in ctes:
            inner = ctes[name]
            parent = self.table(inner.table, {k: v for k, v in ctes.items() if k != name})
            rest = {k: v for k, v in ctes.items() if k != name}
            if not inner.limit_given and not inner.searches:
                inner = n.Select(**{**inner.__dict__, "limit": None})
            df = self.plan(inner, rest).df
            have = set(df.columns)
            keep = lambda c: c if c in have else None
            return Table(df, parent.id_col if parent.id_col in have else "id", keep(parent.text_col), keep(parent.vec_col), keep(parent.sparse_col), keep(parent.meta_col))
        return self.tables(name)

    # kinds of queries

    def aggregated(self, q: n.Select, base: Table, scope: Scope, docs: DataFrame) -> Result:
        if q.searches:
            docs, _ = self.hits(q, base, docs)
        keys = q.group_by
        for i in q.items or []:
            if not isinstance(i.expr, n.Agg) and i.expr not in keys:
                raise SqlError(f"{i.name} is neither grouped nor aggregated")
        names = {e: next((i.name for i in q.items or [] if i.expr == e), n.label(e)) for e in keys}
        aggregates = [(i.name, i.expr) for i in q.items or [] if isinstance(i.expr, n.Agg)]
        if not keys and any(a.fn != "count" for _, a in aggregates) and self.compat:
            raise SqlError("without GROUP BY only COUNT is allowed")
        extra = [(f"__{a.label()}", a) for a in _aggregates_of(q.having) if a not in [x for _, x in aggregates] and a.label() not in [x for x, _ in aggregates]]
        df = olap.grouped(docs, scope, [(names[e], e) for e in keys], aggregates + extra, "_null", self.compat)
        out = Scope(df, now_ms=self.now_ms)
        if q.having is not None:
            df = df.where(out.predicate(_by_name(q.having, {**{a: name for name, a in aggregates + extra}, **{e: names[e] for e in keys}})))
        order = [self.direction(out.value(_renamed(e, {a: name for name, a in aggregates} | names)).col, down) for e, down in q.order_by] + [F.col(f"`{names[e]}`") for e in keys]
        shown = [F.col(f"`{i.name}`") for i in q.items or []] or [F.col(f"`{c}`") for c in df.columns]
        df = page(df, order, q.limit if q.limit != 0 else None, q.offset)
        return Result(df.select(*shown), id_col=base.id_col)

    def scan(self, q: n.Select, base: Table, scope: Scope, docs: DataFrame) -> Result:
        docs = docs.withColumn("score", F.lit(0.0)) if "score" not in docs.columns else docs
        order = self.order(q, base, scope, [F.col(base.id_col)])
        if q.distinct:
            docs = olap.distinct_first(docs, self.shown_exprs(q, base, scope), order)
        if q.limit is None and not q.offset and not q.order_by:
            order = []  # all rows: nothing depends on their order
        found = olap.facets(docs, scope, q.facets, q.facet_limit) if q.facets else None
        return Result(page(docs, order, 1 if q.limit == 0 else q.limit, q.offset).select(*self.shown(q, base, scope)), found, id_col=base.id_col)

    def search(self, q: n.Select, base: Table, scope: Scope, docs: DataFrame) -> Result:
        hits, stages = self.hits(q, base, docs)
        if q.rescore and q.dense is not None:
            hits = fusion.rescored(hits, base.vec_col, self.query_vector(q))
            stages.append(("rescored", hits))
        if q.boosts or q.decay:
            hits = fusion.adjusted(hits, scope, q.boosts, q.decay)
            stages.append(("boosted", hits))
        found = olap.facets(hits, scope, q.facets, q.facet_limit) if q.facets else None
        order = self.order(q, base, scope, [F.desc("score"), F.col(base.id_col)])
        if q.distinct:
            hits = olap.distinct_first(hits, self.shown_exprs(q, base, scope), order)
        hits = page(hits, order, q.limit if q.limit != 0 else 1, q.offset)
        stages.append(("page", hits))
        shown = self.shown(q, base, scope)
        if q.boosts or q.decay:
            shown += [c for c in (F.col("base"), F.col("boost"), F.col("decay")) if q.items is None]
        if q.highlight is not None:
            terms = tokens_of(q.lexical.text) if q.lexical else tokens_of(q.dense.text)
            shown.append(highlight(F.col(base.text_col), terms, q.highlight or 160).alias("snippet"))
        return Result(hits.select(*shown), found, stages=stages, id_col=base.id_col)

    # parts

    def query_vector(self, q: n.Select) -> list[float]:
        return q.dense.vector if q.dense.vector is not None else hashed_vector(q.dense.text or "", 64)

    def keyed(self, base: Table, docs: DataFrame) -> tuple[DataFrame, str]:
        """``docs`` and the name of a column that tells its rows apart, but for rows that are equal in all columns."""
        if base.has_unique_ids():
            return docs, base.id_col
        columns = [F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
        return docs.withColumn(ROW, F.struct(F.col(base.id_col), F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))), ROW

    def hits(self, q: n.Select, base: Table, docs: DataFrame) -> tuple[DataFrame, list]:
        """All matches with their columns and score, and the stages that led there."""
        stages: list = []
        if q.dense is not None and not base.vec_col:
            raise SqlError(f"{q.table} has no vector column")
        if (q.lexical is not None and q.dense is not None) or q.score == "rrf":
            docs, key = self.keyed(base, docs)
            lists = []
            if q.lexical is not None:
                lists.append(self.lexical(q, base, docs, key))
                stages.append((q.lexical.method, lists[-1]))
            if q.dense is not None:
                lists.append(dense.scored(docs, self.query_vector(q), key, base.vec_col, q.dense.dims))
                stages.append(("dense", lists[-1]))
            if key == ROW:  # equal rows have equal scores
                lists = [x.dropDuplicates([ROW]) for x in lists]
            fused = fusion.rrf(lists, q.fusion_k, key)
            hits = docs.drop("score").join(fused, key).drop(ROW)
            stages = [(name, x.withColumn(base.id_col, F.col(f"{ROW}.{base.id_col}")) if key == ROW else x) for name, x in stages] + [("fused", hits)]
        elif q.lexical is not None:
            hits = self.lexical(q, base, docs)
            stages.append((q.lexical.method, hits))
        else:
            hits = dense.scored(docs, self.query_vector(q), base.id_col, base.vec_col, q.dense.dims, keep_all=True)
            stages.append(("dense", hits))
        if q.crag:
            hits = fusion.crag(hits, base.id_col)
            stages.append(("crag", hits))
        if q.graph_depth:
            near = fusion.near(hits, docs, q.graph_depth, base.id_col)
            hits = hits.unionByName(docs.drop("score", ROW).join(F.broadcast(near), base.id_col).select(*hits.columns))
            stages.append(("expanded", hits))
        return hits, stages

    def lexical(self, q: n.Select, base: Table, docs: DataFrame, key: str | None = None) -> DataFrame:
        """All columns and the score; or, with a key, (key, score)."""
        lx = q.lexical
        k1, b = lexical.K1 if lx.k1 is None else lx.k1, lexical.B if lx.b is None else lx.b
        if lx.method != "bm25" and lx.weights is not None and base.sparse_col:
            if lx.method == "splade":
                return lexical.splade(docs, lx.weights, key or base.id_col, base.sparse_col, keep_all=key is None)
            return self.by_key(lambda some, k: lexical.seismic(some, lx.weights, k, base.sparse_col), base, docs, key)
        query = lexical.expanded_query(base.df, lx.text, base.id_col, base.text_col, k1=k1, b=b) if q.hyde else lx.text
        if base.index and not q.hyde:  # indexes are of tables on disk, whose ids are unique
            hits = lexical.bm25_indexed(base.df.sparkSession, base.index, lx.text, k1, b).withColumnRenamed("id", base.id_col)
            return docs.drop("score").join(hits, base.id_col).select(*([base.id_col, "score"] if key else ["*"]))
        return lexical.bm25(docs, query, key or base.id_col, base.text_col, k1, b, corpus=base.df, keep_all=key is None)

    def by_key(self, scores, base: Table, docs: DataFrame, key: str | None) -> DataFrame:
        """What ``scores(docs, key)`` gives, joined to all columns if the caller has no key of its own."""
        if key:
            return scores(docs, key)
        docs, key = self.keyed(base, docs)
        return docs.drop("score").join(scores(docs.dropDuplicates([key]) if key == ROW else docs, key), key).drop(ROW)

    def shown_exprs(self, q: n.Select, base: Table, scope: Scope) -> list[Column]:
        if q.items is None:
            return [F.col(base.id_col)]
        return [F.round("score", 6) if i.expr == n.Col("score") else scope.value(i.expr).col for i in q.items]

    def shown(self, q: n.Select, base: Table, scope: Scope) -> list[Column]:
        if q.items is None:
            return [F.col(c) for c in dict.fromkeys([base.id_col, "score", *([base.text_col] if base.text_col else [])])]
        out: dict[str, Column] = {}
        for i in q.items:  # of equal names the first counts
            col = F.col("score") if i.expr == n.Col("score") else scope.value(i.expr).col
            out.setdefault(i.name, col.alias(i.name))
        return list(out.values())

    def direction(self, col: Column, down: bool) -> Column:
        return col.desc_nulls_last() if down else col.asc_nulls_first()

    def order(self, q: n.Select, base: Table, scope: Scope, default: list[Column]) -> list[Column]:
        if not q.order_by:
            return default
        keys = [self.direction(F.col("score") if e == n.Col("score") else scope.value(e).col, down) for e, down in q.order_by]
        return [*keys, F.col(base.id_col)]


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int) -> DataFrame:
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def _aggregates_of(p) -> list[n.Agg]:
    if p is None:
        return []
    if isinstance(p, (n.And, n.Or)):
        return [a for x in p.parts for a in _aggregates_of(x)]
    return [p.left] if isinstance(p.left, n.Agg) else []


def _renamed(e: n.Expr, names: dict) -> n.Expr:
    return n.Col(names[e]) if e in names else e


def _by_name(p, names: dict):
    if isinstance(p, (n.And, n.Or)):
        return type(p)(tuple(_by_name(x, names) for x in p.parts))
    return type(p)(**{**p.__dict__, "left": _renamed(p.left, names)})
