"""Lexer and recursive-descent parser of the retrieval dialect; what it does not know is an error."""

from __future__ import annotations

import re

from ..functions.scalar import ARITY
from . import nodes as n

_TOKEN = re.compile(r"""\s+|--[^\n]*|(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|'(?P<str>(?:[^']|'')*)'|"(?P<quoted>(?:[^"]|"")+)"|(?P<word>[^\W\d]\w*)|(?P<op><=|>=|!=|<>|[=<>(),.\[\]*;+-])""")
AGGREGATES = ("count", "sum", "avg", "min", "max")
DEFAULT_LIMIT = 20


class SqlError(ValueError):
    """The statement cannot be parsed or planned."""


def tokens_of(text: str) -> list[tuple[str, object, int]]:
    """(kind, value, position); kinds are word, quoted, num, str, op and end."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "num":
            raw = m.group()
            out.append(("num", float(raw) if re.search(r"[.eE]", raw) else int(raw), at))
        elif kind == "str":
            out.append(("str", m.group("str").replace("''", "'"), at))
        elif kind == "quoted":
            out.append(("quoted", m.group("quoted").replace('""', '"'), at))
        elif kind:
            out.append((kind, m.group(), at))
        at = m.end()
    return [*out, ("end", "", len(text))]


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens_of(text), 0

    # tokens

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these key words or signs."""
        for k, word in enumerate(words):
            kind, value, _ = self.tokens[min(self.at + k, len(self.tokens) - 1)]
            if kind not in ("word", "op") or str(value).upper() != word:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, why: str):
        kind, value, at = self.tokens[self.at]
        raise SqlError(f"{why}, found {'the end' if kind == 'end' else repr(value)} at {at}")

    def name(self) -> str:
        kind, value, _ = self.tokens[self.at]
        if kind not in ("word", "quoted"):
            self.fail("expected a name")
        self.at += 1
        return value if kind == "quoted" else value.lower()

    def table_name(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    def number(self) -> int | float:
        sign = -1 if self.take("-") else 1
        self.take("+")
        kind, value, _ = self.tokens[self.at]
        if kind != "num":
            self.fail("expected a number")
        self.at += 1
        return sign * value

    def whole(self) -> int:
        value = self.number()
        if not isinstance(value, int) or value < 0:
            self.fail("expected a whole number")
        return value

    def string(self) -> str:
        kind, value, _ = self.tokens[self.at]
        if kind != "str":
            self.fail("expected a string")
        self.at += 1
        return value

    def literal(self) -> str | int | float:
        if self.tokens[self.at][0] == "str":
            return self.string()
        if self.take("TRUE"):
            return "true"
        if self.take("FALSE"):
            return "false"
        return self.number()

    # expressions

    def expr(self, aggregates: bool = False) -> n.Expr:
        kind, value, _ = self.tokens[self.at]
        if kind in ("num", "str") or self.peek("-"):
            return n.Lit(self.literal())
        name = self.name()
        if self.take("."):
            return n.Col(self.name())
        if kind == "word" and aggregates and name == "count" and not self.peek("("):
            return n.Agg("count")
        if not self.take("("):
            return n.Col(name)
        if name in AGGREGATES:
            if not aggregates:
                self.fail("an aggregate is not allowed here")
            arg = None
            if not self.peek(")"):
                arg = None if self.take("*") else self.expr()
            self.need(")")
            if name == "count":
                return n.Agg("count")
            if arg is None:
                self.fail(f"{name} needs a column")
            return n.Agg(name, arg)
        args = []
        while not self.peek(")"):
            args.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        if name not in ARITY:
            raise SqlError(f"unknown function {name}")
        low, high = ARITY[name]
        if not low <= len(args) <= high:
            raise SqlError(f"{name} takes {low} to {high} arguments, not {len(args)}")
        return n.Func(name, tuple(args))

    def predicate(self, aggregates: bool = False) -> n.Predicate:
        parts = [self.conjunction(aggregates)]
        while self.take("OR"):
            parts.append(self.conjunction(aggregates))
        return parts[0] if len(parts) == 1 else n.Or(tuple(parts))

    def conjunction(self, aggregates: bool) -> n.Predicate:
        parts = [self.leaf(aggregates)]
        while self.take("AND"):
            parts.append(self.leaf(aggregates))
        return parts[0] if len(parts) == 1 else n.And(tuple(parts))

    def leaf(self, aggregates: bool) -> n.Predicate:
        if self.take("("):
            inner = self.predicate(aggregates)
            self.need(")")
            return inner
        left = self.expr(aggregates)
        negated = self.take("NOT")
        if self.take("BETWEEN"):
            low = self.literal()
            self.need("AND")
            return n.Between(left, low, self.literal(), negated)
        if self.take("LIKE"):
            return n.Like(left, self.string(), negated)
        if negated:
            self.fail("expected BETWEEN or LIKE")
        if self.take("IN"):
            self.need("(")
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(")")
            return n.In(left, tuple(values))
        for op in ("<=", ">=", "!=", "<>", "=", "<", ">"):
            if self.take(op):
                return n.Cmp(left, "!=" if op == "<>" else op, self.literal())
        self.fail("expected a comparison")

    # statements

    def statement(self):
        out = self._statement()
        self.take(";")
        if self.tokens[self.at][0] != "end":
            self.fail("unexpected token")
        return out

    def _statement(self):
        if self.peek("SELECT") or self.peek("WITH") or self.peek("EXPLAIN") or self.peek("STREAM"):
            return self.query()
        if self.take("CREATE", "TABLE"):
            name, columns, mode = self.table_name(), [], "hybrid"
            if self.take("("):
                while True:
                    columns.append((self.name(), self.type_name()))
                    if not self.take(","):
                        break
                self.need(")")
            if self.take("USING"):
                mode = self.name()
                if mode not in ("text", "vector", "hybrid"):
                    raise SqlError(f"unknown table mode {mode}")
            return n.CreateTable(name, columns, mode)
        if self.take("CREATE", "INDEX"):
            name = self.name()
            self.need("ON")
            table, column = self.table_name(), None
            if self.take("("):
                column = self.name()
                self.need(")")
            self.need("USING")
            return n.CreateIndex(name, table, column, self.name())
        if self.take("CREATE", "MATERIALIZED", "VIEW"):
            name = self.name()
            self.need("AS")
            start = self.tokens[self.at][2]
            query = self.query()
            return n.CreateView(name, query, self.text[start:].rstrip().rstrip(";"))
        if self.take("REFRESH", "MATERIALIZED", "VIEW"):
            return n.Command("refresh_view", self.name())
        if self.take("DROP", "MATERIALIZED", "VIEW"):
            return n.Command("drop_view", self.name())
        if self.take("SHOW", "MATERIALIZED", "VIEWS"):
            return n.Command("show_views")
        if self.take("DROP", "TABLE"):
            return n.Command("drop_table", self.table_name())
        if self.take("SHOW", "TABLES"):
            return n.Command("show_tables")
        if self.take("SHOW", "INDEXES", "FROM"):
            return n.Command("show_indexes", self.table_name())
        if self.take("SHOW", "CREATE", "TABLE"):
            return n.Command("show_create", self.table_name())
        if self.take("DESCRIBE") or self.take("DESC"):
            return n.Command("describe", self.table_name())
        if self.take("COMPACT", "TABLE"):
            name = self.table_name()
            return n.Command("compact_full" if self.take("FULL") else "compact", name)
        if self.take("ALTER", "TABLE"):
            name = self.table_name()
            if self.take("ALTER", "COLUMN"):
                column = self.name()
                self.need("TYPE")
                return n.AlterType(name, column, self.type_name(), self.take("REWRITE"))
            self.need("SET", "SEGMENT_WORKERS", "=")
            workers = self.whole()
            if workers < 1:
                raise SqlError("SEGMENT_WORKERS must be at least 1")
            return n.AlterWorkers(name, workers)
        if self.take("DELETE", "FROM"):
            table = self.table_name()
            self.need("WHERE")
            ids = ids_of(self.predicate())
            if ids is None:
                raise SqlError("DELETE takes id = n, id IN (...), and OR of these")
            return n.Delete(table, ids)
        self.fail("unknown statement")

    def type_name(self) -> str:
        out = self.name()
        for left, right in (("(", ")"), ("[", "]")):
            if self.take(left):
                sizes = [str(self.whole())]
                while self.take(","):
                    sizes.append(str(self.whole()))
                self.need(right)
                out += f"({','.join(sizes)})"
        return out

    def query(self) -> n.Select:
        explain = self.take("EXPLAIN")
        stream = self.take("STREAM")
        ctes: dict[str, n.Select] = {}
        if self.take("WITH"):
            while True:
                name = self.name()
                self.need("AS")
                self.need("(")
                ctes[name] = self.query()
                self.need(")")
                if not self.take(","):
                    break
        out = self.select()
        out.ctes, out.explain, out.stream = ctes, out.explain or explain, out.stream or stream
        if out.explain and out.stream:
            raise SqlError("EXPLAIN cannot be combined with STREAM")
        return out

    def select(self) -> n.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = None
        if not self.take("*"):
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
        self.need("FROM")
        q = n.Select(self.table_name(), items, distinct, limit=DEFAULT_LIMIT)
        seen: set[str] = set()
        while not (self.peek(";") or self.peek(")") or self.tokens[self.at][0] == "end"):
            clause = str(self.tokens[self.at][1]).upper()
            if clause in seen and clause not in ("BOOST", "JOIN"):
                self.fail(f"{clause} is given twice")
            seen.add(clause)
            self.clause(q)
        return q

    def item(self) -> n.Item:
        e = self.expr(aggregates=True)
        if self.take("AS"):
            return n.Item(e, self.name())
        if self.tokens[self.at][0] in ("word", "quoted") and not self.peek("FROM"):
            return n.Item(e, self.name())
        return n.Item(e)

    def clause(self, q: n.Select) -> None:
        if self.take("JOIN"):
            table = self.table_name()
            self.need("ON")
            sides = []
            for k in range(2):
                owner = self.name()
                self.need(".")
                sides.append((owner, self.name()))
                if not k:
                    self.need("=")
            right = [s for s in sides if s[0] == table]
            if len(right) != 1:
                raise SqlError("JOIN ... ON must name both tables")
            left = sides[1 - sides.index(right[0])]
            q.joins.append(n.Join(table, left[1], right[0][1]))
        elif self.take("WHERE"):
            q.where = self.predicate()
        elif self.take("GROUP", "BY"):
            q.group_by = [self.expr()]
            while self.take(","):
                q.group_by.append(self.expr())
        elif self.take("HAVING"):
            q.having = self.predicate(aggregates=True)
        elif self.take("ORDER", "BY"):
            while True:
                key = self.expr(aggregates=True)
                score = key == n.Col("score")
                q.order_by.append((key, self.take("DESC") or (not self.take("ASC") and score)))
                if not self.take(","):
                    break
        elif self.take("LIMIT"):
            q.limit, q.limit_given = None if self.take("ALL") else self.whole(), True
        elif self.take("OFFSET"):
            q.offset = self.whole()
        elif self.take("HYDE"):
            q.hyde = True
        elif self.take("CRAG"):
            q.crag = True
        elif self.take("GRAPH", "EXPAND"):
            q.graph_depth = self.whole() if self.tokens[self.at][0] == "num" else 1
        elif self.take("FUSION", "K"):
            self.take("=")
            q.fusion_k = self.whole()
        elif self.take("DISTRIBUTED"):
            q.distributed = True
        elif self.take("STREAM"):
            q.stream = True
        elif self.take("EXPLAIN"):
            q.explain = True
        elif self.take("FACETS"):
            q.facets = self.in_parens(self.name)
        elif self.take("BOOST"):
            self.need("(")
            name = self.name()
            self.need(",")
            q.boosts.append((name, float(self.number())))
            self.need(")")
        elif self.take("DECAY"):
            self.need("(")
            name = self.name()
            self.need(",")
            if self.take("HALF_LIFE"):
                self.take("=")
            q.decay = (name, float(self.number()))
            self.need(")")
        elif self.take("HIGHLIGHT"):
            self.need("(")
            q.highlight = self.whole()
            self.need(")")
        elif self.take("SPARSE", "SEARCH"):
            q.lexical = self.sparse_search()
        elif self.take("VECTOR", "SEARCH"):
            q.dense = self.vector_search()
        else:
            self.fail("unknown clause")

    def in_parens(self, one) -> list:
        self.need("(")
        out = [one()]
        while self.take(","):
            out.append(one())
        self.need(")")
        return out

    def sparse_search(self) -> n.Lexical:
        column, method = self.name(), "bm25"
        if not self.peek("("):
            method = self.name()
        if method in ("sparse", "text"):
            method = "bm25"
        if method not in ("bm25", "splade", "seismic"):
            raise SqlError(f"unknown sparse method {method}")
        self.need("(")
        out = n.Lexical(self.string(), method, column)
        while self.take(","):
            name = self.name()
            if name not in ("k1", "b"):
                raise SqlError(f"{method} takes k1= and b=, not {name}")
            self.take("=")
            setattr(out, name, float(self.number()))
        self.need(")")
        return out

    def vector_search(self) -> n.Dense:
        column = self.name()
        if not self.peek("("):
            method = self.name()
            if method not in ("ann", "dot", "hnsw", "diskann", "ivf"):
                raise SqlError(f"unknown vector method {method}")
        self.need("(")
        out = n.Dense(column=column)
        if self.take("["):
            out.vector = [float(self.number())]
            while self.take(","):
                out.vector.append(float(self.number()))
            self.need("]")
        else:
            text = self.string()
            try:
                out.vector = [float(x) for x in text.split(",")] if "," in text else None
            except ValueError:
                raise SqlError("a vector string holds numbers and commas") from None
            out.text = None if out.vector else text
        self.need(")")
        return out


def ids_of(p: n.Predicate) -> list[int] | None:
    """The ids that a predicate of id = n, id IN (...) and OR of these names; None for other predicates."""
    if isinstance(p, n.Or):
        parts = [ids_of(x) for x in p.parts]
        return None if None in parts else sorted({i for x in parts for i in x})
    if p.__class__ is n.Cmp and p.left == n.Col("id") and p.op == "=":
        values = [p.value]
    elif isinstance(p, n.In) and p.left == n.Col("id"):
        values = list(p.values)
    else:
        return None
    try:
        return sorted({int(v) for v in values})
    except ValueError:
        return None


def parse(text: str):
    return Parser(text).statement()
