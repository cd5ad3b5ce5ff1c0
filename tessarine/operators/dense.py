"""Dense retrieval: exact inner products, optionally over few dimensions, or approximate first and exact after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Names of index kinds that are all answered by the exact scan.
EXACT = ("dense", "vector", "hnsw", "ann", "diskann", "ivf", "muvera", "dot")


def scored(docs: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding", dims: int | None = None, keep_all: bool = False) -> DataFrame:
    """(id_col, score), or all columns and the score: inner products; rows with null vectors or of another length are left out. A map-only scan."""
    columns = [F.col(c) for c in docs.columns if c.lower() != "score"] if keep_all else [F.col(id_col)]
    return docs.select(*columns, vectors.dot(F.col(vec_col), query, dims).alias("score")).where("score is not null")


def top(scores: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best, ties by id, taken in every task and then once."""
    return scores.orderBy(F.desc("score"), id_col).limit(k)


def reranked(docs: DataFrame, coded: DataFrame, query: list[float], k: int, factor: int = 4, bits: int = 4, seed: int = 1, id_col: str = "id", vec_col: str = "embedding", code_col: str = "code") -> DataFrame:
    """The k best by exact product among the ``k * factor`` best by codes; the candidates' size is fixed."""
    rough = coded.select(F.col(id_col), vectors.turbo_dot(F.col(code_col), query, bits, seed).alias("score")).where("score is not null")
    near = top(rough, k * factor, id_col).select(id_col)
    return top(scored(docs.join(F.broadcast(near), id_col, "left_semi"), query, id_col, vec_col), k, id_col)
