"""Tokens, snippets and hashed text vectors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters and digits, or of Khmer characters; a change of script splits.
TOKEN = "[a-z0-9]+|[ក-៿᧠-᧿]+"
_FOLD = str.maketrans(UPPER, LOWER)
_TOKEN = re.compile(TOKEN)


def tokens(text: Column) -> Column:
    """The tokens of a text; ASCII letters alone are lower-cased. Null for null."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1))


def tokens_of(text: str | None) -> list[str]:
    """The same on the driver, for query texts."""
    return _TOKEN.findall((text or "").translate(_FOLD))


def _snap(data: bytes, at: int, step: int) -> int:
    """The nearest start of a character at or beyond ``at`` in the direction of ``step``."""
    if at >= len(data):
        return len(data)
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def snippet(text: str | None, terms: Iterable[str], size: int = 160, opening: str = "<em>", closing: str = "</em>") -> str | None:
    """About ``size`` bytes of the text around the densest group of matched tokens, which are marked.

    White space is collapsed; an ellipsis stands where the text goes on. Without a match
    it is the start of the text. Null stays null.
    """
    if text is None:
        return None
    size, wanted, data = max(size, 16), set(terms), text.encode("utf-8", "surrogatepass")
    # one byte for one byte: tokens are found on the text, their places counted in bytes
    hits, at, seen = [], 0, 0
    for m in _TOKEN.finditer(text.translate(_FOLD)):
        if m.group() in wanted:
            at += len(text[seen : m.start()].encode("utf-8", "surrogatepass"))
            seen = m.start()
            hits.append((at, at + len(m.group().encode())))
    if not hits:
        end = _snap(data, min(size, len(data)), 1)
        return " ".join(data[:end].decode("utf-8", "replace").split()) + ("…" if end < len(data) else "")
    starts, ends = np.array([a for a, _ in hits]), np.array([b for _, b in hits])
    low = np.maximum(starts - size // 3, 0)
    counts = np.maximum(np.searchsorted(ends, low + size, "right") - np.searchsorted(starts, low, "left"), 0)
    middle = int(starts[int(counts.argmax())])
    start, end = _snap(data, max(middle - size // 2, 0), -1), _snap(data, min(middle + size // 2, len(data)), 1)
    parts, cursor = [], start
    for a, b in hits:
        if a >= cursor and b <= end:
            parts += [data[cursor:a].decode("utf-8", "replace"), opening, data[a:b].decode(), closing]
            cursor = b
    parts.append(data[cursor:end].decode("utf-8", "replace"))
    return ("…" if start > 0 else "") + " ".join("".join(parts).split()) + ("…" if end < len(data) else "")


def highlight(text: Column, terms: Iterable[str], size: int = 160) -> Column:
    wanted = sorted(set(terms))

    @F.pandas_udf(T.StringType())
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: snippet(t, wanted, size), na_action="ignore")

    return mark(text)


def hashed_vector(text: str | None, dim: int) -> list[float] | None:
    """A bag of tokens hashed into ``dim`` cells, of unit length; zeros for a text without tokens."""
    if text is None:
        return None
    out = np.zeros(dim)
    for t in tokens_of(text):
        out[xxhash.xxh64_intdigest(t.encode()) % dim] += 1.0
    size = np.linalg.norm(out)
    return (out / size if size else out).tolist()


def proxy_embedding(text: Column, dim: int = 64) -> Column:
    """A vector for tables and queries that have none: see :func:`hashed_vector`."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: np.array(hashed_vector(t, dim), dtype=np.float32), na_action="ignore")

    return embed(text)


def vector_literal(text: Column) -> Column:
    """``[1,2]`` or ``1,2`` to an array of floats; null if it is empty or holds anything else."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), ",")
    out = F.transform(parts, lambda x: F.trim(x).try_cast("float"))
    return F.when(~F.exists(out, lambda x: x.isNull()), out)
