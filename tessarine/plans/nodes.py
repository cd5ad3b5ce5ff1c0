"""The query representation: expressions, predicates and statements as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: str | int | float


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple

    def label(self) -> str:
        return f"{self.name}({', '.join(map(label, self.args))})"


@dataclass(frozen=True)
class Agg:
    """fn: count, sum, avg, min or max; arg is None for COUNT(*)."""

    fn: str
    arg: Col | Func | None = None

    def label(self) -> str:
        return "count" if self.fn == "count" else f"{self.fn}_{label(self.arg)}"


Expr = Col | Lit | Func | Agg


def label(e: Expr) -> str:
    """The default output name of an expression."""
    if isinstance(e, Col):
        return e.name
    return str(e.value) if isinstance(e, Lit) else e.label()


@dataclass(frozen=True)
class Cmp:
    left: Expr
    op: str
    value: str | int | float


@dataclass(frozen=True)
class In:
    left: Expr
    values: tuple


@dataclass(frozen=True)
class Between:
    left: Expr
    low: str | int | float
    high: str | int | float
    negated: bool = False


@dataclass(frozen=True)
class Like:
    left: Expr
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Predicate = Cmp | In | Between | Like | And | Or


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or label(self.expr)


@dataclass(frozen=True)
class Join:
    """Keeps rows of the left table that have an equal key in the right one."""

    table: str
    left_key: str
    right_key: str


@dataclass
class Lexical:
    """method: bm25, splade or seismic; weights: the query's learned-sparse map, if given."""

    text: str
    method: str = "bm25"
    column: str | None = None
    k1: float | None = None
    b: float | None = None
    weights: dict[str, float] | None = None


@dataclass
class Dense:
    """vector or text (embedded by hashing); dims: how many leading dimensions count."""

    vector: list[float] | None = None
    text: str | None = None
    column: str | None = None
    dims: int | None = None


@dataclass
class Select:
    table: str
    items: list[Item] | None = None  # None: *
    distinct: bool = False
    joins: list[Join] = field(default_factory=list)
    where: Predicate | None = None
    group_by: list[Expr] = field(default_factory=list)
    having: Predicate | None = None
    order_by: list[tuple[Expr, bool]] = field(default_factory=list)  # (key, descending)
    limit: int | None = None
    limit_given: bool = False
    offset: int = 0
    lexical: Lexical | None = None
    dense: Dense | None = None
    fusion_k: int = 60
    score: str = "auto"  # auto, bm25 or rrf
    hyde: bool = False
    crag: bool = False
    graph_depth: int = 0
    facets: list[str] = field(default_factory=list)
    facet_limit: int = 20
    boosts: list[tuple[str, float]] = field(default_factory=list)
    decay: tuple[str, float] | None = None
    highlight: int | None = None
    rescore: bool = False
    distributed: bool = False
    stream: bool = False
    explain: bool = False
    ctes: dict[str, "Select"] = field(default_factory=dict)

    @property
    def aggregates(self) -> bool:
        return bool(self.group_by) or any(isinstance(i.expr, Agg) for i in self.items or [])

    @property
    def searches(self) -> bool:
        return self.lexical is not None or self.dense is not None


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    mode: str = "hybrid"


@dataclass
class CreateIndex:
    name: str
    table: str
    column: str | None
    method: str


@dataclass
class CreateView:
    name: str
    query: Select
    text: str


@dataclass
class AlterType:
    table: str
    column: str
    type: str
    rewrite: bool = False


@dataclass
class AlterWorkers:
    table: str
    workers: int


@dataclass
class Delete:
    table: str
    ids: list[int]


@dataclass
class Command:
    """verb: drop_table, compact, compact_full, describe, show_tables, show_indexes, show_create, show_views, drop_view or refresh_view."""

    verb: str
    name: str | None = None
