"""Scalar functions and predicates as Columns.

Every value carries a static type: int, float, bool, date, timestamp or text. Text that
looks like a number is compared as one; whatever cannot be compared is not a match. No
predicate is wrapped so that a Parquet filter could not be pushed down.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as n

MANY = 99
ARITY = {
    "lower": (1, 1), "upper": (1, 1), "trim": (1, 1), "length": (1, 1), "substr": (2, 3), "substring": (2, 3), "concat": (1, MANY), "coalesce": (1, MANY),
    "abs": (1, 1), "floor": (1, 1), "ceil": (1, 1), "ceiling": (1, 1), "round": (1, 2), "mod": (2, 2), "now": (0, 0), "date_trunc": (2, 2), "extract": (2, 2),
    "age": (1, 1), "nullif": (2, 2), "ifnull": (2, 2),
}
_TRUE, _FALSE = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


@dataclass
class Value:
    col: Column
    type: str


def type_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.DateType):
        return "date"
    return "timestamp" if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)) else "text"


class Scope:
    """Resolves names against a DataFrame: id, text, typed columns, keys of the metadata map, else NULL."""

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str | None = "text", meta_col: str | None = None, now_ms: int = 0):
        self.df, self.id_col, self.text_col, self.meta_col, self.now_ms = df, id_col, text_col, meta_col, now_ms
        self.types = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}

    def __call__(self, name: str) -> Value:
        low = name.lower()
        if low not in self.types:
            low = {"id": self.id_col, "text": self.text_col or ""}.get(low, low).lower()
        if low in self.types:
            real, data_type = self.types[low]
            return Value(F.col(f"`{real}`"), type_of(data_type))
        if self.meta_col and self.meta_col.lower() in self.types:
            return Value(F.element_at(F.col(self.meta_col), name), "text")
        return Value(F.lit(None).cast("string"), "text")

    def value(self, e: n.Expr) -> Value:
        if isinstance(e, n.Lit):
            return Value(F.lit(e.value), {int: "int", float: "float"}.get(type(e.value), "text"))
        if isinstance(e, n.Col):
            return self(e.name)
        if isinstance(e, n.Agg):
            return self(e.label())
        return _FUNCTIONS[e.name](self, *map(self.value, e.args))

    def predicate(self, p: n.Predicate) -> Column:
        if isinstance(p, (n.And, n.Or)):
            parts = [self.predicate(x) for x in p.parts]
            out = parts[0]
            for x in parts[1:]:
                out = out & x if isinstance(p, n.And) else out | x
            return out
        left = self.value(p.left)
        ranges = isinstance(p.left, (n.Func, n.Agg))
        if isinstance(p, n.Cmp):
            return compare(left, p.op, p.value, ranges)
        if isinstance(p, n.In):
            return is_in(left, p.values)
        if isinstance(p, n.Between):
            inside = compare(left, ">=", p.low, ranges) & compare(left, "<=", p.high, ranges)
            # what cannot be compared is not in the range
            return left.col.isNotNull() & ~F.coalesce(inside, F.lit(False)) if p.negated else inside
        hit = as_text(left).like(p.pattern.replace("\\", "\\\\"))
        return ~hit if p.negated else hit


def as_text(v: Value) -> Column:
    if v.type == "float":  # whole numbers have no decimal point
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("bigint").cast("string")).otherwise(v.col.cast("string"))
    return v.col if v.type == "text" else v.col.cast("string")


def as_number(v: Value) -> Column:
    if v.type in ("int", "float"):
        return v.col
    return F.trim(v.col).try_cast("double") if v.type == "text" else F.lit(None).cast("double")


def as_bool(v: Value) -> Column:
    if v.type == "bool":
        return v.col
    low = F.lower(F.trim(as_text(v)))
    return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)


def as_moment(v: Value) -> Column:
    """A timestamp without time zone; null if the text is none."""
    if v.type in ("date", "timestamp"):
        return v.col.cast("timestamp_ntz")
    if v.type == "int":
        return F.timestamp_millis(v.col).cast("timestamp_ntz")
    text = F.regexp_replace(F.trim(as_text(v)), "Z+$", "")
    dashed = F.regexp_replace(text, r"^(\d{4})/(\d\d)/", "$1-$2-")
    return F.when(dashed.rlike(r"^\d{4}-\d\d-\d\d([T ]\d?\d:\d\d(:\d\d(\.\d+)?)?)?$"), dashed).try_cast("timestamp_ntz")


def as_millis(v: Value) -> Column:
    if v.type == "int":
        return v.col.cast("bigint")
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), as_moment(v))


def _number(value) -> int | float | None:
    if isinstance(value, (int, float)):
        return value
    text = value.strip()
    if re.fullmatch(r"[+-]?\d{1,18}", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return None


def _op(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def compare(left: Value, op: str, value, ranges: bool = False) -> Column:
    """``left op literal``. ranges: whether texts that are no numbers have an order."""
    number = _number(value)
    if left.type in ("int", "float") and number is not None:
        return _op(left.col, op, F.lit(number))
    if left.type == "bool":
        flag = str(value).strip().lower()
        if flag in _TRUE + _FALSE:
            return _op(left.col, op, F.lit(flag in _TRUE))
    if left.type in ("date", "timestamp"):
        if re.match(r"\s*\d{4}[-/]\d\d[-/]\d\d", str(value)):
            literal = as_moment(Value(F.lit(str(value)), "text"))
            return _op(left.col, op, literal.cast("date") if left.type == "date" and len(str(value).strip()) <= 10 else literal)
    text = as_text(left)
    plain = _op(text, op, F.lit(str(value))) if ranges or op in ("=", "!=") else F.lit(False)
    if left.type != "text" or number is None:
        return plain
    return F.when(as_number(left).isNotNull(), _op(as_number(left), op, F.lit(float(number)))).otherwise(plain)


def is_in(left: Value, values: tuple) -> Column:
    numbers = [_number(v) for v in values]
    if left.type in ("int", "float") and None not in numbers:
        return left.col.isin(*numbers)
    if left.type == "text" and not any(x is not None for x in numbers):
        return left.col.isin(*map(str, values))
    out = F.lit(False)
    for v in values:
        out = out | compare(left, "=", v)
    return out


def _text(make: Callable[[Column], Column]) -> Callable[..., Value]:
    return lambda scope, x: Value(make(as_text(x)), "text")


def _substr(scope: Scope, x: Value, start: Value, size: Value | None = None) -> Value:
    first = F.greatest(F.coalesce(as_number(start).cast("int"), F.lit(1)), F.lit(1))
    count = F.lit(2147483647) if size is None else F.greatest(F.coalesce(as_number(size).cast("int"), F.lit(0)), F.lit(0))
    return Value(F.substring(as_text(x), first, count), "text")


def _abs(scope: Scope, x: Value) -> Value:
    return Value(F.abs(as_number(x)), "int" if x.type == "int" else "float")


def _round(scope: Scope, x: Value, digits: Value | None = None) -> Value:
    if digits is None:
        return Value(F.round(as_number(x).cast("double")).cast("bigint"), "int")
    factor = F.pow(F.lit(10.0), as_number(digits))
    return Value(F.round(as_number(x).cast("double") * factor) / factor, "float")


def _mod(scope: Scope, a: Value, b: Value) -> Value:
    whole = a.type == "int" and b.type == "int"
    x, y = (as_number(v).cast("bigint" if whole else "double") for v in (a, b))
    return Value(F.when(y != 0, F.try_mod(x, y)), "int" if whole else "float")


def _unit(v: Value) -> Column:
    return F.lower(as_text(v))


def _date_trunc(scope: Scope, unit: Value, x: Value) -> Value:
    at = as_moment(x)
    forms = {"year": "yyyy-01-01'T'00:00:00", "month": "yyyy-MM-01'T'00:00:00", "day": "yyyy-MM-dd'T'00:00:00", "hour": "yyyy-MM-dd'T'HH:00:00", "minute": "yyyy-MM-dd'T'HH:mm:00"}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, form in forms.items():
        out = out.when(_unit(unit) == name, F.date_format(at, form))
    return Value(out, "text")


def _extract(scope: Scope, part: Value, x: Value) -> Value:
    at = as_moment(x)
    parts = {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at), "minute": F.minute(at), "second": F.second(at), "epoch": F.expr("0")}
    parts["epoch"] = F.floor(as_millis(x) / 1000)
    out = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for name, col in parts.items():
        out = out.when(_unit(part) == name, col.cast("bigint"))
    return Value(out, "int")


def _nullif(scope: Scope, a: Value, b: Value) -> Value:
    x, y = as_number(a), as_number(b)
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(as_text(a) == as_text(b))
    return Value(F.when(~F.coalesce(same, F.lit(False)), a.col), a.type)


def _first(scope: Scope, *xs: Value) -> Value:
    kinds = {x.type for x in xs}
    if len(kinds) == 1:
        return Value(F.coalesce(*[x.col for x in xs]), xs[0].type)
    if kinds == {"int", "float"}:
        return Value(F.coalesce(*[x.col.cast("double") for x in xs]), "float")
    return Value(F.coalesce(*map(as_text, xs)), "text")


_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "lower": _text(F.lower),
    "upper": _text(F.upper),
    "trim": _text(lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")),
    "length": lambda scope, x: Value(F.length(as_text(x)).cast("bigint"), "int"),
    "substr": _substr,
    "substring": _substr,
    "concat": lambda scope, *xs: Value(F.concat_ws("", *map(as_text, xs)), "text"),
    "coalesce": _first,
    "ifnull": _first,
    "nullif": _nullif,
    "abs": _abs,
    "floor": lambda scope, x: Value(F.floor(as_number(x)).cast("bigint"), "int"),
    "ceil": lambda scope, x: Value(F.ceil(as_number(x)).cast("bigint"), "int"),
    "ceiling": lambda scope, x: Value(F.ceil(as_number(x)).cast("bigint"), "int"),
    "round": _round,
    "mod": _mod,
    "now": lambda scope: Value(F.lit(scope.now_ms).cast("bigint"), "int"),
    "age": lambda scope, x: Value(F.lit(scope.now_ms).cast("bigint") - as_millis(x), "int"),
    "date_trunc": _date_trunc,
    "extract": _extract,
}
