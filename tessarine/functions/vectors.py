"""Products of vectors and their quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many dimensions a product is one generated expression without a loop.
UNROLLED = 256


def dot(vector: Column, query: list[float], dims: int | None = None) -> Column:
    """The inner product with a query, over the first ``dims`` dimensions; null where lengths differ."""
    use = query[:dims] if dims else query
    if len(use) <= UNROLLED:
        terms = [F.get(vector, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(use)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
    else:
        total = dot_of(F.slice(vector, 1, len(use)), F.lit([float(q) for q in use]))
    return F.when(F.size(vector) == len(query), total)


def dot_of(a: Column, b: Column) -> Column:
    """The inner product of two vector columns; null where lengths differ."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def quantize8(vector: Column) -> Column:
    """struct(min, scale, codes): each entry in 0..255 steps above the vector's least entry."""
    v = vector.cast("array<double>")
    least = F.array_min(v)
    scale = F.greatest((F.array_max(v) - least) / 255.0, F.lit(1.1920928955078125e-07))
    codes = F.transform(v, lambda x: F.least(F.greatest(F.floor((x - least) / scale), F.lit(0)), F.lit(255)).cast("int"))
    return F.struct(least.alias("min"), scale.alias("scale"), codes.alias("codes"))


def dequantize8(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: code["min"] + c * code["scale"])


@lru_cache(maxsize=8)
def codebook(bits: int) -> np.ndarray:
    """The Lloyd-Max centroids of the standard normal distribution, found by iteration."""
    if not 1 <= bits <= 4:
        raise ValueError("bits must be 1 to 4")
    phi = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    area = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))
    centres = np.linspace(-1.5, 1.5, 1 << bits)
    for _ in range(4000):
        edges = np.concatenate([[-np.inf], (centres[1:] + centres[:-1]) / 2, [np.inf]])
        weight = area(edges[1:]) - area(edges[:-1])
        moved = (np.where(np.isinf(edges[:-1]), 0, phi(edges[:-1])) - np.where(np.isinf(edges[1:]), 0, phi(edges[1:]))) / weight
        if np.abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return centres


def _transform(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of rows whose width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def _signs(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), width)


def turbo_encode(x: np.ndarray, bits: int, seed: int = 1, residual: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sigmas, codes, residual scales, residual signs) of rows: rotated, then each entry to its nearest centroid."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    rotated = _transform(np.pad(x, ((0, 0), (0, width - x.shape[1]))) * _signs(width, seed))
    sigma = np.linalg.norm(rotated, axis=1) / math.sqrt(width)
    book = codebook(bits)
    unit = rotated / np.where(sigma > 0, sigma, 1)[:, None]
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, unit).astype(np.int16)
    left = rotated - sigma[:, None] * book[codes]
    if not residual:
        return sigma, codes, np.zeros(len(x)), np.zeros((len(x), 0), np.int16)
    return sigma, codes, np.abs(left).mean(axis=1), (left >= 0).astype(np.int16)


def turbo_query(query: list[float], seed: int = 1) -> np.ndarray:
    width = 1 << max(0, (len(query) - 1).bit_length())
    return _transform(np.pad(np.array(query, dtype=float), (0, width - len(query)))[None, :] * _signs(width, seed))[0]


TURBO = T.StructType([T.StructField("sigma", T.DoubleType()), T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("residual", T.DoubleType()), T.StructField("signs", T.ArrayType(T.ShortType()))])


def turbo_quantize(vector: Column, bits: int = 4, seed: int = 1, residual: bool = False) -> Column:
    """Codes of 1 to 4 bits an entry after a seeded rotation; null vectors stay null."""

    @F.pandas_udf(TURBO)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            out = pd.DataFrame({"sigma": np.full(len(vectors), np.nan), "codes": [None] * len(vectors), "residual": np.full(len(vectors), np.nan), "signs": [None] * len(vectors)}, dtype=object)
            sizes = vectors.map(lambda v: 0 if v is None else len(v))
            for size in sizes[sizes > 0].unique():
                rows = np.flatnonzero(sizes == size)
                s, c, r, g = turbo_encode(np.stack(vectors.iloc[rows].to_numpy()).astype(float), bits, seed, residual)
                for at, row in enumerate(rows):
                    out.iloc[row] = [float(s[at]), c[at], float(r[at]), g[at]]
            yield out

    return encode(vector)


def turbo_dot(code: Column, query: list[float], bits: int = 4, seed: int = 1) -> Column:
    """The estimated inner product of a coded vector and a query, without decoding: looked up and summed in the JVM."""
    turned, book = turbo_query(query, seed), codebook(bits)
    table = F.lit([[float(q * c) for c in book] for q in turned])
    main = F.aggregate(F.zip_with(code["codes"], table, lambda c, row: F.get(row, c.cast("int"))), F.lit(0.0), lambda s, x: s + x) * code["sigma"]
    rest = F.aggregate(F.zip_with(code["signs"], F.lit([float(q) for q in turned]), lambda s, q: F.when(s.isNull(), 0.0).when(s == 1, q).otherwise(-q)), F.lit(0.0), lambda s, x: s + x) * code["residual"]
    return main + F.coalesce(rest, F.lit(0.0))
