"""Grouping, HAVING, facets, DISTINCT in order, semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Scope, as_number, as_text
from ..plans import nodes as n


def aggregate(scope: Scope, a: n.Agg, compat: bool = False) -> Column:
    """COUNT counts rows; the others skip what is no number, and give null for nothing (compat: 0)."""
    if a.fn == "count":
        return F.count(F.lit(1))
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](as_number(scope.value(a.arg)).cast("double"))
    return F.coalesce(made, F.lit(0.0)) if compat else made


def grouped(df: DataFrame, scope: Scope, keys: list[tuple[str, n.Expr]], aggregates: list[tuple[str, n.Agg]], null_label: str | None = "_null", compat: bool = False) -> DataFrame:
    """Partial and final aggregation by typed keys in columns of their own.

    null_label: what missing text keys are called; None, and keys of other types, keep null.
    """
    cols = []
    for name, e in keys:
        v = scope.value(e)
        cols.append((F.coalesce(v.col, F.lit(null_label)) if null_label is not None and v.type == "text" else v.col).alias(name))
    made = [aggregate(scope, a, compat).alias(name) for name, a in aggregates] or [F.count(F.lit(1)).alias("count")]
    return df.groupBy(*cols).agg(*made) if cols else df.agg(*made)


def facets(df: DataFrame, scope: Scope, fields: list[str], most: int = 20, null_label: str = "_null") -> DataFrame:
    """(field, value, count, rank): the ``most`` frequent values of each field, ties by value; one pass for all fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(as_text(scope(f)), F.lit(null_label)).alias("value")) for f in fields])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def distinct_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each combination of keys."""
    names = [f"__k{i}" for i in range(len(keys))]
    tagged = df.select("*", *[k.alias(x) for k, x in zip(keys, names)])
    return tagged.withColumn("__at", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("__at = 1").drop("__at", *names)


def semi_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Rows of ``left`` with an equal key in ``right``; null never matches; no columns of ``right``."""
    keys = right.select(right_key.alias("__right_key"))
    return left.join(keys, left_key == F.col("__right_key"), "left_semi")


def tagged(df: DataFrame, scope: Scope, names: list[str]) -> Column:
    """Whether a row has all of these metadata keys."""
    return reduce(lambda a, b: a & b, [scope(x).col.isNotNull() for x in names], F.lit(True))
