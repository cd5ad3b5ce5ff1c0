"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length and padded to a power of two. A hash is a fast
pseudo-rotation (three times: random signs, then a Hadamard transform) followed by the
nearest signed axis. A table's cells are the combinations of its hashes. The first hash
uses all signed axes; more follow, the last over a part of the axes, as far as needed to
leave about ``per_cell`` vectors in a cell. A query probes, in each of the ``tables``
tables, the ``probes`` cells whose axes are nearest, best first. All vectors of a probed
cell are compared exactly, by a matrix product in double precision, and the ``k`` best
over all tables remain.

The number of probes comes from a simulation of the plan: as many as it needs to find
``recall`` of the neighbours that uniform vectors of that number and dimension have, the
hardest case. There is one way of search at every size of the table.

A vector is sent once for each table: cells that follow each other form blocks of about
``block`` vectors, a block's vectors and the queries that probe any of its cells meet in
one task, and a query is sent once for each block, with the list of its cells there.
Blocks are at most MOST_BLOCKS for a table; one with more than ``block`` vectors or
queries is cut into parts that all meet, so no task holds more of either.

Defined results
---------------
* null ids, null or empty vectors, vectors of zero length, with null or non-finite
  entries, or of another dimension than most vectors have: neither queries nor points.
* repeated ids: the smallest vector of the id counts, once.
* equal vectors are neighbours with similarity 1; ties rank by id. Of the copies of one
  vector only the k + 1 with the smallest ids can be among anyone's k neighbours, so only
  these are points; all of them may be queries.
* similarities are rounded to 12 places, so that ties do not depend on the order of sums.
* fewer than k other vectors: as many rows as there are.
* an empty table gives an empty result; extra columns are ignored.
* an id column named like a result column: the latter gets an underscore.
* ids are integers; others raise TypeError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, named, type_of

RECALL, SIMULATED, MOST_BLOCKS = 0.95, 2000, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=256)
def signs(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(3, width))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for row in signs(width, seed):
        x = hadamard(x * row)
    return x


def nearest_axes(x: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first; axis i is 2i or, if negative, 2i+1."""
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    if count == 1:
        return both.argmax(axis=1)[:, None]
    if count < both.shape[1]:
        top = np.argpartition(-both, count - 1, axis=1)[:, :count]
    else:
        top = np.broadcast_to(np.arange(both.shape[1]), both.shape)
    order = np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def cells(x: np.ndarray, table: int, hashes: list[int], probes: int, seed: int) -> np.ndarray:
    """The codes of each row's ``probes`` nearest cells in a table, best first; fewer if there are fewer cells."""
    codes, gains = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for h, axes in enumerate(hashes):
        turned = rotated(x, seed + 1009 * table + h)[:, : axes // 2]
        near = nearest_axes(turned, min(probes, axes))
        value = np.take_along_axis(np.stack([turned, -turned], axis=2).reshape(len(x), -1), near, 1)
        codes = (codes[:, :, None] * axes + near[:, None, :]).reshape(len(x), -1)
        gains = (gains[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        if codes.shape[1] > probes:
            best = np.argsort(-gains, axis=1, kind="stable")[:, :probes]
            codes, gains = np.take_along_axis(codes, best, 1), np.take_along_axis(gains, best, 1)
    return codes


def expected_cosines(n: int, dim: int, ranks: np.ndarray) -> np.ndarray:
    """The cosines that about ``ranks`` of n uniform vectors exceed."""
    angle = np.linspace(0, math.pi, 200_001)
    below = np.cumsum(np.sin(angle) ** max(dim - 2, 0))
    return np.cos(np.interp(ranks / n, below / below[-1], angle))


def simulated_pairs(n: int, dim: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Uniform unit vectors, and for each another at the cosine of one of its k nearest of n."""
    rng = np.random.default_rng(seed)
    q, side = rng.normal(size=(2, SIMULATED, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    side -= (side * q).sum(axis=1, keepdims=True) * q
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    cosine = expected_cosines(n, dim, np.arange(SIMULATED) % k + 0.5)[:, None]
    return q, cosine * q + np.sqrt(1 - cosine**2) * side


def plan(n: int, dim: int, per_cell: int = 400, tables: int = 3, k: int = 10, recall: float = RECALL, seed: int = 5) -> tuple[list[int], int]:
    """(signed axes of each hash, number of probes in a table) for n vectors."""
    whole = 1 + max(1, (dim - 1).bit_length())  # bits of a hash over all signed axes
    bits = max(whole, math.ceil(math.log2(max(n, 1) / per_cell)))
    hashes = [1 << whole] * (bits // whole) + ([1 << (bits % whole)] if bits % whole else [])
    q, point = simulated_pairs(n, dim, k, seed)
    probes, all_cells = 64, 1 << bits
    while True:
        probes = min(probes, all_cells)
        rank = np.full(SIMULATED, all_cells)
        for t in range(tables):
            for at in range(0, SIMULATED, 250):
                hit = cells(q[at : at + 250], t, hashes, probes, seed) == cells(point[at : at + 250], t, hashes, 1, seed)
                found = np.where(hit.any(axis=1), hit.argmax(axis=1), all_cells)
                rank[at : at + 250] = np.minimum(rank[at : at + 250], found)
        needed = int(np.sort(rank)[math.ceil(recall * SIMULATED) - 1]) + 1
        if needed <= probes or probes == all_cells:
            return hashes, min(needed, all_cells)
        probes *= 4


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(__id, __v: the vector's bytes), the number of rows and the dimension."""
    kind = "float" if type_of(df, vec_col) == "array<float>" else "double"
    base = df.select(F.col(id_col).alias("__id"), F.col(vec_col).cast(f"array<{kind}>").alias("__a")).where("__id is not null and size(__a) > 0")
    base = base.where(~F.exists("__a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("__a", lambda x: x != 0))
    dims = base.groupBy(F.size("__a").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return base, 0, 0
    dim = dims["d"]
    base = base.where(F.size("__a") == dim)
    if not base.groupBy("__id").count().where("count > 1").isEmpty():
        base = base.groupBy("__id").agg(F.min("__a").alias("__a"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["__a"].to_numpy())
                yield pd.DataFrame({"__id": batch["__id"], "__v": [r.tobytes() for r in x]})

    out = cut(base.mapInPandas(pack, f"__id {type_of(base, '__id')}, __v binary"))
    return out, out.count(), dim


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    raw = b"".join(column)
    x = np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dim * len(column) else np.float64).reshape(len(column), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by similarity and then by id."""
    first = np.argsort(ids, axis=1, kind="stable")
    order = np.take_along_axis(first, np.argsort(-np.take_along_axis(sims, first, 1), axis=1, kind="stable"), 1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def neighbours(
    df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 1, tables: int = 3, per_cell: int = 400, block: int = 50_000, recall: float = RECALL, seed: int = 5
) -> DataFrame:
    """(id, neighbour, similarity, rank): the approximate k nearest others, by cosine, of every vector whose id is divisible by ``every``."""
    kind = type_of(df, id_col)
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be integers")
    units, n, dim = unit_vectors(df, id_col, vec_col)
    columns = named(id_col, ("neighbour", "similarity", "rank"))
    result = f"`{id_col}` {kind}, {columns[0]} {kind}, {columns[1]} double, {columns[2]} int"
    if not n:
        return df.sparkSession.createDataFrame([], result)
    hashes, probes = plan(n, dim, per_cell, tables, k, recall, seed)
    all_cells = math.prod(hashes)
    blocks = min(all_cells, MOST_BLOCKS, -(-n // block))

    of_vector = Window.partitionBy(F.xxhash64("__v"), "__v").orderBy("__id")
    points = units.withColumn("__r", F.row_number().over(of_vector)).where(F.col("__r") <= k + 1).drop("__r")
    queries = units.where(F.pmod("__id", F.lit(every)) == 0)

    def block_lists(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(row, block, cells there) for each block that a row's cells are in."""
        rows = np.repeat(np.arange(len(codes)), codes.shape[1])
        flat = codes.ravel()
        where = flat * blocks // all_cells
        order = np.lexsort((flat, where, rows))
        rows, where, flat = rows[order], where[order], flat[order]
        starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (where[1:] != where[:-1])])
        return rows[starts], where[starts], np.split(flat, starts[1:])

    def counted(asking: bool):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((tables, blocks), dtype=np.int64)
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["__v"], dim)
                    for t in range(tables):
                        codes = cells(x, t, hashes, probes if asking else 1, seed)
                        where = block_lists(codes)[1] if asking else codes[:, 0] * blocks // all_cells
                        total[t] += np.bincount(where, minlength=blocks)
            t, b = np.nonzero(total)
            yield pd.DataFrame({"t": t.astype(np.int32), "b": b, "n": total[t, b]})

        rows = (queries if asking else points).mapInPandas(count, "t int, b long, n long").groupBy("t", "b").agg(F.sum("n").alias("n")).collect()
        parts = np.ones((tables, blocks), dtype=np.int64)
        for r in rows:  # at most tables * MOST_BLOCKS
            parts[r["t"], r["b"]] = -(-r["n"] // block)
        return parts

    points = cut(points)
    p_parts, q_parts = counted(False), counted(True)

    def placed(asking: bool):
        mine, other = (q_parts, p_parts) if asking else (p_parts, q_parts)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x, ids = _matrix(batch["__v"], dim), batch["__id"].to_numpy()
                for t in range(tables):
                    codes = cells(x, t, hashes, probes if asking else 1, seed)
                    if asking:
                        rows, where, lists = block_lists(codes)
                    else:
                        rows, where, lists = np.arange(len(ids)), codes[:, 0] * blocks // all_cells, codes[:, 0]
                    part = _part(ids[rows], mine[t, where])
                    for p in range(other[t, where].max()):
                        at = np.flatnonzero(other[t, where] > p)
                        pp, qp = (p, part[at]) if asking else (part[at], p)
                        c = [lists[i] for i in at] if asking else lists[at]
                        yield pd.DataFrame({"t": t, "b": where[at], "pp": pp, "qp": qp, "c": c, "__id": ids[rows[at]], "__v": batch["__v"].to_numpy()[rows[at]]})

        cell = "array<long>" if asking else "long"
        return (queries if asking else points).mapInPandas(place, f"t int, b long, pp long, qp long, c {cell}, __id {kind}, __v binary")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"__id": np.array([], dtype=np.int64), "__best": pd.Series([], dtype=object)})
        order = np.lexsort((left["__id"].to_numpy(), left["c"].to_numpy()))
        p_ids, p_cells, p = left["__id"].to_numpy(np.int64)[order], left["c"].to_numpy()[order], _matrix(left["__v"], dim)[order]
        q_ids, q = right["__id"].to_numpy(np.int64), _matrix(right["__v"], dim)
        lists = right["c"].to_numpy()
        asked = np.concatenate(lists)
        who = np.repeat(np.arange(len(q)), [len(c) for c in lists])
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        best = np.full((len(q), k), -np.inf)
        codes, starts = np.unique(asked, return_index=True)
        for code, a, z in zip(codes, starts, np.r_[starts[1:], len(asked)]):
            low, high = np.searchsorted(p_cells, [code, code + 1])
            step = max(1, 2_000_000 // max(high - low, 1))
            for at in range(a, z if high > low else a, step):
                rows = who[at : min(z, at + step)]
                sims = np.round(q[rows] @ p[low:high].T, 12)
                mine = q_ids[rows]
                own = np.searchsorted(p_ids[low:high], mine)
                same = np.flatnonzero((own < high - low) & (p_ids[low + np.minimum(own, high - low - 1)] == mine))
                sims[same, own[same]] = -np.inf
                top, value = _top(sims, k)
                ids = np.where(value > -np.inf, p_ids[low:high][top], np.iinfo(np.int64).max)
                best_ids[rows], best[rows] = _best(np.hstack([best_ids[rows], ids]), np.hstack([best[rows], value]), k)
        real = best > -np.inf
        some = np.flatnonzero(real.any(axis=1))
        blobs = [best_ids[i, real[i]].tobytes() + best[i, real[i]].tobytes() for i in some]
        return pd.DataFrame({"__id": q_ids[some], "__best": pd.Series(blobs, dtype=object)})

    keys = ("t", "b", "pp", "qp")
    lists = placed(False).groupBy(*keys).cogroup(placed(True).groupBy(*keys)).applyInPandas(meet, f"__id {kind}, __best binary")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, blobs in zip(batch["__id"], batch["__all"]):
                ids = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16) for b in blobs])
                sims = np.concatenate([np.frombuffer(b, np.float64, len(b) // 16, len(b) // 2) for b in blobs])
                ids, first = np.unique(ids, return_index=True)
                sims = sims[first]
                order = np.lexsort((ids, -sims))[:k]
                out.append(pd.DataFrame(dict(zip((id_col, *columns), (key, ids[order], sims[order], np.arange(1, len(order) + 1, dtype=np.int32))))))
            if out:
                yield pd.concat(out)

    # a query has a list of at most k for each block that it probed
    return lists.groupBy("__id").agg(F.collect_list("__best").alias("__all")).mapInPandas(merge, result)


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row; of equal ones the first columns."""
    if sims.shape[1] > k:
        kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        rank = np.where(sims > kth, 2, np.where(sims == kth, 1, 0)).astype(np.int8)
        top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
    else:
        top = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return top, np.take_along_axis(sims, top, 1)
