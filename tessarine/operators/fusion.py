"""Rank fusion, corrective filtering, expansion by neighbours, boosts, decay, rescoring, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Scope, as_millis, as_text
from ..functions.vectors import dot

NEIGHBOUR_SCORE, MOST_NEIGHBOURS = 0.4, 256


def ranked(list_: DataFrame, id_col: str = "id", depth: int | None = None, ranges: int = 64) -> DataFrame:
    """(id_col, score, rank from 1), by score, ties by id.

    depth: rank the best ``depth`` only, a top-k of fixed size. Without it all rows are
    ranked: score percentiles cut them into ranges, every range is numbered on its own
    and shifted by the number of rows in the ranges above, so no task sorts everything.
    """
    order = (F.desc("score"), F.col(id_col))
    if depth is not None:
        return list_.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    edges = list_.agg(F.percentile_approx("score", F.lit([i / ranges for i in range(1, ranges)]), F.lit(10_000)).alias("__edges"))
    above = F.coalesce(F.size(F.filter("__edges", lambda e: e > F.col("score"))), F.lit(0))
    placed = list_.crossJoin(F.broadcast(edges)).withColumn("__range", above).drop("__edges")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return inside.join(F.broadcast(shift), "__range").withColumn("rank", F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def rrf(lists: list[DataFrame], k: int = 60, id_col: str = "id", depth: int | None = None) -> DataFrame:
    """(id_col, score): the sum over the lists of 1 / (k + rank)."""
    parts = [ranked(x, id_col, depth).select(id_col, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("score").alias("score"))


def crag(candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """Drops scores below the upper median; a single candidate stays."""
    n = candidates.agg(F.count("*").alias("__n"))
    at = ranked(candidates.select(id_col, "score"), id_col).crossJoin(F.broadcast(n))
    median = at.where(F.expr("rank = __n - __n div 2")).select(F.col("score").alias("__median"))
    return candidates.crossJoin(F.broadcast(median)).where("score >= __median").drop("__median")


def graph_expand(candidates: DataFrame, docs: DataFrame, depth: int, id_col: str = "id", most: int = MOST_NEIGHBOURS) -> DataFrame:
    """The candidates, and documents whose id is at most ``depth`` away from one, with a fixed score.

    The nearest come first, ties by id, ``most`` of them.
    """
    return candidates.select(id_col, "score").unionByName(near(candidates, docs, depth, id_col, most))


def near(candidates: DataFrame, docs: DataFrame, depth: int, id_col: str = "id", most: int = MOST_NEIGHBOURS) -> DataFrame:
    """(id_col, score): the ids that :func:`graph_expand` adds."""
    key = F.col(id_col)
    near = candidates.select(key.alias("__seed"), F.explode(F.sequence(key - depth, key + depth)).alias(id_col)).where("__seed <> " + f"`{id_col}`")
    near = near.groupBy(id_col).agg(F.min(F.abs(key - F.col("__seed"))).alias("__away"))
    near = near.join(candidates.select(id_col), id_col, "left_anti").join(docs.select(id_col), id_col, "left_semi")
    return near.orderBy("__away", id_col).limit(most).select(id_col, F.lit(NEIGHBOUR_SCORE).alias("score"))


def boost_factor(scope: Scope, boosts: list[tuple[str, float]]) -> Column:
    """The product of the factors whose field is there and not blank."""
    out = F.lit(1.0)
    for name, factor in boosts:
        out = out * F.when(F.trim(as_text(scope(name))) != "", F.lit(float(factor))).otherwise(F.lit(1.0))
    return out


def decay_factor(scope: Scope, decay: tuple[str, float] | None) -> Column:
    """0.5 ** (age in days / half-life); 1 for missing and future dates."""
    if decay is None or decay[1] <= 0:
        return F.lit(1.0)
    days = (F.lit(scope.now_ms) - as_millis(scope(decay[0]))) / F.lit(86_400_000.0)
    return F.when(days > 0, F.pow(F.lit(0.5), days / F.lit(float(decay[1])))).otherwise(F.lit(1.0))


def adjusted(hits: DataFrame, scope: Scope, boosts: list[tuple[str, float]], decay: tuple[str, float] | None) -> DataFrame:
    """``hits`` with base, boost, decay, and score as their product."""
    out = hits.withColumns({"base": F.col("score"), "boost": boost_factor(scope, boosts), "decay": decay_factor(scope, decay)})
    return out.withColumn("score", F.col("base") * F.col("boost") * F.col("decay"))


def rescored(hits: DataFrame, vec_col: str, query: list[float]) -> DataFrame:
    """The exact inner product instead of the score, where the row has a vector of that length."""
    return hits.withColumn("score", F.coalesce(dot(F.col(vec_col), query), F.col("score")))


def provenance(stages: list[tuple[str, DataFrame]], id_col: str = "id") -> DataFrame:
    """(stage, id, score, rank, dropped): each stage's rows, and whether the next stage left them out."""
    out = []
    for at, (name, rows) in enumerate(stages):
        here = ranked(rows.select(id_col, "score"), id_col).withColumn("stage", F.lit(name))
        if at + 1 < len(stages):
            following = stages[at + 1][1].select(F.col(id_col)).distinct().withColumn("__there", F.lit(True))
            here = here.join(following, id_col, "left").withColumn("dropped", F.col("__there").isNull()).drop("__there")
        else:
            here = here.withColumn("dropped", F.lit(False))
        out.append(here.select("stage", id_col, "score", "rank", "dropped"))
    return reduce(DataFrame.unionByName, out)
