"""The user's code: functions from texts to vectors or to sparse weights, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder:
    """Wraps a function from texts to vectors of one dimension, which is learned if it is not given."""

    def __init__(self, func: Callable[[list[str]], Sequence[Sequence[float]]], dim: int | None = None):
        if not callable(func):
            raise TypeError("an embedder is a function from a list of texts to a list of vectors")
        self.func, self.dim = func, dim

    @classmethod
    def coerce(cls, given) -> "Embedder | None":
        """An Embedder, a function, or an object with embed_documents."""
        if given is None or isinstance(given, cls):
            return given
        if hasattr(given, "embed_documents"):
            return cls(given.embed_documents)
        return cls(given)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        out = [[float(x) for x in v] for v in self.func(list(texts))]
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        self.dim = self.dim or len(out[0])
        if any(len(v) != self.dim for v in out):
            raise ValueError(f"not all vectors have {self.dim} dimensions")
        return out

    def column(self, text: Column) -> Column:
        """Vectors of a column; null for null. A dimension that is learned is learned in each task."""
        embedder = self

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = pd.Series([None] * len(texts), dtype=object)
                known = np.flatnonzero(texts.notna())
                for at, v in zip(known, embedder.embed(texts.iloc[known].tolist())):
                    out.iat[at] = v
                yield out

        return run(text)


class SparseEncoder(Embedder):
    """Wraps a function from texts to maps of token weights."""

    def __init__(self, func: Callable[[list[str]], Sequence[dict[str, float]]]):
        super().__init__(func)

    @classmethod
    def coerce(cls, given) -> "SparseEncoder | None":
        if given is None or isinstance(given, cls):
            return given
        return cls(given.encode_documents if hasattr(given, "encode_documents") else given)

    def encode(self, texts: list[str]) -> list[dict[str, float]]:
        out = [{str(k): float(v) for k, v in dict(m).items()} for m in self.func(list(texts))] if texts else []
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} maps for {len(texts)} texts")
        return out

    def column(self, text: Column) -> Column:
        encoder = self

        @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.FloatType())])))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = pd.Series([None] * len(texts), dtype=object)
                known = np.flatnonzero(texts.notna())
                for at, m in zip(known, encoder.encode(texts.iloc[known].tolist())):
                    out.iat[at] = [{"k": k, "v": v} for k, v in m.items()]
                yield out

        return F.map_from_entries(run(text))
