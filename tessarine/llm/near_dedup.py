"""Near-duplicate removal by circulant MinHash.

A text is the set of its word trigrams (lower-cased; words are runs of bytes that are
neither ASCII white space, ASCII punctuation nor ASCII control characters). Two
permutations of the universe of all 32-bit numbers suffice for all coordinates of a
signature: the first, sigma, scatters the trigrams; the second, pi, is shifted
circularly by k for the k-th coordinate, so coordinate k is the least pi(sigma(x) + k)
over the set. Both are computed, not stored (invertible mixing of 32-bit numbers), so the
universe is far larger than any text's set and long texts do not saturate it.

Documents with equal trigram sets form one node. Signatures are cut into bands. In the
first round all nodes of a band's bucket are compared to the one with the smallest id. In
each further round some nodes of every bucket that holds more than one group, chosen by a
hash, at least four times as many as in the round before, are compared to all the others
that are not yet connected to them; then these leaders leave the bucket. So every pair of
a bucket is compared unless its ends are in one group already. A bucket is done when all
it holds is in one group. A comparison is the exact Jaccard similarity of the trigram
sets, made from the whole texts. Where the first node is near most of a group, thousands
of copies cost a number of comparisons in proportion to their size; members that are near
nothing are compared to the whole bucket. No bucket is capped. The groups are the
connected components of the links at or above ``threshold``.

Nothing brings all rows of one key to one task: what is wanted of a key's rows is
aggregated before the shuffle and joined back (``common.with_facts``), and joins of a
bucket with its leaders are cut into parts of 50,000 members.

Defined results
---------------
* null text, or text without words: no signature, in no group, kept.
* one or two words: the set holds that one short sequence.
* null id: such rows cannot be grouped and are kept as they are.
* repeated ids: rows with one id are one document, represented by the text with the
  smallest 64-bit hash; :func:`deduplicated` keeps one row of it.
* the document with the smallest id of each group stays (no ties: ids are unique by then).
* very long texts are compared whole, like any other.
* an empty table gives an empty result. Extra columns are kept by :func:`deduplicated`
  and ignored by :func:`groups`. An id column called duplicate_of: the result's gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, lookup, mix64, named, span_hashes, type_of, with_facts

SHINGLE = 3
#: Members of a bucket, or of a leader, that one task compares or joins.
PART, CHUNK = 50_000, 2000
_SEPARATORS = bytes(range(33)) + bytes(c for c in range(33, 128) if not chr(c).isalnum())
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SEPARATORS)] = False


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingles_of(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's word trigrams, each once."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], _IS_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    words = span_hashes(raw, edges[0::2], edges[1::2])
    if not len(words):
        return words
    if len(words) < SHINGLE:
        mixed = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for w in words:
                mixed = mix64(np.array([mixed * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
        return np.array([mixed], dtype=np.uint64)
    joined = words[:-2] * np.uint64(0xA24BAED4963EE407) + words[1:-1] * np.uint64(0x9FB21C651E98DF25) + words[2:] * np.uint64(0xC13FA9A902A6328F)
    return np.unique(mix64(joined))


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """All coordinates of the circulant signature of a set that is not empty."""
    scattered = mix32((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF))
    shifts = np.arange(coordinates, dtype=np.uint32)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(scattered), 1024):
        np.minimum(out, mix32(scattered[start : start + 1024, None] + shifts).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, different between bands for equal contents."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in rows.T:
        key = mix64(key + column)
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, seed: int) -> DataFrame:
    """(__id, __hash of the text, __set: digest of the trigram set, __bands), one row per id."""
    id_type = type_of(docs, id_col)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets, keys = [], []
            for text in batch["__text"]:
                s = shingles_of(text)
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows, seed), bands) if len(s) else np.empty(0, dtype=np.int64))
            yield pd.DataFrame({"__id": batch["__id"], "__hash": batch["__hash"], "__set": sets, "__bands": keys})

    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    base = base.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    return base.mapInPandas(sign, f"__id {id_type}, __hash long, __set binary, __bands array<long>").where("__set is not null")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (__id, __leader) whose trigram sets have at least that Jaccard similarity.

    A leader's text is sent once for about CHUNK of its members, which splits large
    groups over tasks, and a member's once for each of its leaders. Groups are streamed
    in sorted order; none has to fit in memory.
    """
    id_type = type_of(pairs, "__id")
    parts = F.pmod(F.xxhash64("__id"), F.ceil(F.col("__n") / CHUNK)).cast("int")
    members = with_facts(pairs, ["__leader"]).select("__leader", "__id", parts.alias("__part"))
    leaders = members.select("__leader", F.col("__leader").alias("__id"), "__part").distinct()
    sent = members.withColumn("__member", F.lit(1)).unionByName(leaders.withColumn("__member", F.lit(0)))
    rows = sent.join(texts, "__id").repartition("__leader", "__part").sortWithinPartitions("__leader", "__part", "__member")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first = None, None
        for batch in batches:
            ids, leads = [], []
            for leader, part, member, key, text in zip(batch["__leader"], batch["__part"], batch["__member"], batch["__id"], batch["__text"]):
                if member == 0:
                    at, first = (leader, part), shingles_of(text)
                elif at == (leader, part) and jaccard(first, shingles_of(text)) >= threshold:
                    ids.append(key)
                    leads.append(leader)
            yield pd.DataFrame({"__id": pd.Series(ids, dtype=batch["__id"].dtype), "__leader": pd.Series(leads, dtype=batch["__id"].dtype)})

    return rows.select("__leader", "__part", "__member", "__id", "__text").mapInPandas(compare, f"__id {id_type}, __leader {id_type}")


def components(edges: DataFrame, at_most: int = 0) -> DataFrame:
    """(__id, __group): the smallest id that each end of the edges (__id, __leader) is connected to.

    Up to ``at_most`` edges are connected by the driver, which saves small jobs.

    Alternates between linking all larger neighbours, then all smaller ones, to a node's
    least neighbour, until nothing changes: a logarithmic number of rounds. A node's least
    neighbour is aggregated and joined to its edges; no row holds a node's neighbours.
    """
    e = cut(edges.select(F.greatest("__id", "__leader").alias("u"), F.least("__id", "__leader").alias("v")).where("u <> v").distinct())
    if e.count() <= at_most:
        above: dict = {}

        def root(key):
            while key in above:
                above[key] = above.get(above[key], above[key])
                key = above[key]
            return key

        for u, v in e.toLocalIterator():
            low, high = sorted((root(u), root(v)))
            if low != high:
                above[high] = low
        kind = type_of(e, "u")
        return cut(e.sparkSession.createDataFrame([(key, root(key)) for key in list(above)], f"__id {kind}, __group {kind}"), e)
    before = None
    while True:
        both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = with_facts(both, ["u"], F.min("v").alias("m")).select("u", "v", F.least("u", "m").alias("m"))
        large = cut(least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), both)
        down = with_facts(large, ["u"], F.min("v").alias("m"))
        small = down.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small, e, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("__id"), F.col("v").alias("__group"))
        before = now


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, seed: int, broadcast_ids: int, round_pairs: int = 2_000_000) -> DataFrame:
    """(__id, __group) of every document that is not the first of its group."""
    repeated = not repeated_ids(docs, id_col).isEmpty()
    signed = signatures(docs, id_col, text_col, bands, rows, seed)
    if repeated:
        signed = signed.groupBy("__id").agg(F.min(F.struct("__hash", "__set", "__bands")).alias("__row")).select("__id", "__row.*")
    signed = cut(signed)
    nodes = signed.groupBy("__set").agg(F.count("*").alias("__n"), F.min(F.struct("__id", "__hash")).alias("__first"), F.first("__bands").alias("__bands"))
    nodes = cut(nodes.select("__set", "__n", "__first.*", "__bands"))

    at_driver = min(broadcast_ids, 200_000)
    each = cut(nodes.select("__id", F.explode("__bands").alias("__key")))
    members = cut(with_facts(each, ["__key"], F.min("__id").alias("__leader"), having="__n > 1"), each)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        needed = cut(nodes.select("__id", "__hash").join(ids, "__id", "left_semi"))
        if needed.count() <= broadcast_ids:
            needed = F.broadcast(needed)
        found = texts.join(needed, ["__id", "__hash"], "left_semi")
        return found.dropDuplicates(["__id"]) if repeated else found

    in_play = members.select("__id").distinct()
    if in_play.count() > broadcast_ids:
        texts = cut(texts_of(in_play))
    kind = type_of(nodes, "__id")
    grouped, tried = docs.sparkSession.createDataFrame([], f"__id {kind}, __group {kind}"), None
    turn, left = 0, members.count()
    while left:
        if turn == 0:
            pairs = members.where("__id <> __leader").select("__id", "__leader").distinct()
        else:
            share = F.lit(max(4**turn, round_pairs // left)) / F.col("__n")
            chosen = F.pmod(F.xxhash64("__id", F.lit(turn)), F.lit(1 << 30)) / F.lit(1 << 30) < share
            parts = F.ceil(F.col("__n") / PART)
            lead = members.where(chosen).select("__key", F.col("__id").alias("__leader"), F.col("__group").alias("__other"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__part"))
            met = members.withColumn("__part", F.pmod(F.xxhash64("__id"), parts)).join(lead, ["__key", "__part"]).where("__group <> __other")
            pairs = met.groupBy(F.least("__id", "__leader").alias("__low"), F.greatest("__id", "__leader").alias("__high")).agg(F.min("__leader").alias("__leader"))
            pairs = pairs.select(F.when(F.col("__leader") == F.col("__low"), F.col("__high")).otherwise(F.col("__low")).alias("__id"), "__leader")
        key = (F.least("__id", "__leader").alias("__low"), F.greatest("__id", "__leader").alias("__high"))
        pairs = pairs.select("*", *key)
        pairs = cut(pairs.join(tried, ["__low", "__high"], "left_anti") if tried else pairs)
        tried = tried.unionByName(pairs.select("__low", "__high")) if tried else pairs.select("__low", "__high")
        if not pairs.isEmpty():
            ends = pairs.select("__id").unionByName(pairs.select(F.col("__leader").alias("__id"))).distinct()
            linked = cut(verified(pairs.select("__id", "__leader"), texts_of(ends).select("__id", "__text"), threshold))
            if not linked.isEmpty():
                grouped = components(grouped.select("__id", F.col("__group").alias("__leader")).unionByName(linked), at_driver)
        stay = members.where("__id <> __leader") if turn == 0 else members.where(~chosen)
        stay = stay.select("__key", "__id").join(grouped, "__id", "left").select("__key", "__id", F.coalesce("__group", "__id").alias("__group"))
        apart = with_facts(stay, ["__key"], F.min("__group").alias("__least"), F.max("__group").alias("__most"), having="__least <> __most")
        members = cut(apart.select("__key", "__id", "__group", "__n"), members)
        left, turn = members.count(), turn + 1

    of_set = nodes.join(grouped, "__id", "left").select("__set", "__n", F.coalesce("__group", "__id").alias("__group"), F.col("__group").isNotNull().alias("__linked"))
    of_set = cut(of_set.where("__n > 1 or __linked"))
    return cut(lookup(signed.select("__id", "__set"), of_set, ["__set"]).where("__id <> __group").select("__id", "__group"), signed, nodes)


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).count()
    return ids.where("count > 1").select("__id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, bands: int = 32, rows: int = 4, seed: int = 11, broadcast_ids: int = 500_000) -> DataFrame:
    """One row for each document to remove: (id_col, ``duplicate_of``: the one of its group that stays).

    Texts are fetched for documents that share a bucket only. Up to ``broadcast_ids``
    such ids are broadcast, which saves a shuffle of all texts; beyond, texts are
    shuffled to them once and the reduced table is kept. The result is the same.
    """
    found = _groups(docs, id_col, text_col, threshold, bands, rows, seed, broadcast_ids)
    return found.select(F.col("__id").alias(id_col), F.col("__group").alias(*named(id_col, ("duplicate_of",))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, bands: int = 32, rows: int = 4, seed: int = 11, broadcast_ids: int = 500_000) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = _groups(docs, id_col, text_col, threshold, bands, rows, seed, broadcast_ids)
    gone, at = free(docs, "__gone"), free(docs, "__at")
    removed = cut(found.select(F.col("__id").alias(gone)))
    if removed.count() <= broadcast_ids:
        removed = F.broadcast(removed)
    key = F.col(id_col)
    kept = docs.where(key.isNotNull()).join(removed, key == F.col(gone), "left_anti")
    repeated = cut(repeated_ids(docs, id_col).withColumnRenamed("__id", gone))
    if not repeated.isEmpty():
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).isNull(), F.xxhash64(text_col))
        many = kept.join(repeated, key == F.col(gone), "left_semi").withColumn(at, F.row_number().over(order))
        kept = kept.join(repeated, key == F.col(gone), "left_anti").unionByName(many.where(F.col(at) == 1).drop(at))
    return kept.unionByName(docs.where(key.isNull()))
