"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text: each byte's random number is added to the
doubled hash, so the hash at a place depends on the 32 bytes before it and on nothing
else. A chunk ends where chosen bits of the hash are zero. Chunking is normalised: from
``minimum`` up to ``normal`` bytes more bits must be zero, from there to ``maximum``
fewer, which narrows the spread of lengths. Inserted bytes shift the text but not its
boundaries beyond the next one, so the set of chunk digests resists shifts.

A document's fingerprint is its set of chunk digests, weighted by chunk length. The
containment of A in B is the weight of A's chunks that B has, over the weight of A.

All pairs of documents with at least ``min_containment`` are found, exactly, and told by
classes: documents that hold the same shared chunks (those of more than one document) are
one class, whatever else they hold, so copies are one class and so are texts that have
nothing but a passage in common. A chunk set decides what two documents share, so a link
between two classes is one between all of their members, see :func:`containment`.

Classes are packed into blocks of :data:`PART` chunks, and every block of texts that can
be contained meets every block of classes in a task of a Cartesian product, which reads
the blocks anew and shuffles nothing. There the weights of equal digests are added up, so
candidate pairs never leave their task: what leaves it is a count for each length of a
class's members, see :func:`links`, or the links, see :func:`containment`. The work is the
number of pairs of classes by the chunks that they share, which a chunk that a fixed part
of all documents hold makes quadratic. How many documents hold a chunk is aggregated and
joined back; no task gets all rows of a chunk.

Defined results
---------------
* null or empty texts: no chunks, no fingerprint rows, in no pair.
* a text of at most ``minimum`` bytes is one chunk.
* a chunk that occurs several times in a document counts once in its set.
* null ids are left out of classes; :func:`fingerprints` keeps them.
* repeated ids: the union of the rows' chunks is the fingerprint, once each.
* documents that share no chunk with another are in no class and have no row.
* ties: the class is called by its smallest id.
* empty tables give empty results; extra columns are ignored. Result columns that are
  called like the id column get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, named, setting, shuffles_dropped, type_of

WINDOW_DOUBLINGS = 5
#: Chunks of a block, of which one task joins two, and the bits that a chunk's length has beside its document's.
PART, LENGTH_BITS = 1_000_000, 24
#: Equal chunks of two blocks that are added up at once, or those of one class where they are more.
ENTRIES = 500_000
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32 bytes, by doubling the window five times."""
    h = _GEAR[raw]
    for k in range(WINDOW_DOUBLINGS):
        step = 1 << k
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def boundaries(raw: np.ndarray, minimum: int, normal: int, maximum: int) -> list[int]:
    """The ends of the chunks of a text that is not empty."""
    n = len(raw)
    bits = max(1, normal.bit_length() - 1)
    if n <= minimum:
        return [n]
    top = gear_hashes(raw)
    strict = np.flatnonzero(top >> np.uint32(32 - bits - 2) == 0) + 1
    loose = np.flatnonzero(top >> np.uint32(32 - bits + 2) == 0) + 1
    strict_list, loose_list = strict.tolist() + [n], loose.tolist() + [n]
    ends, at, s, l = [], 0, 0, 0
    while n - at > minimum:
        low, mid, high = at + minimum, at + normal, min(at + maximum, n)
        while strict_list[s] < low:
            s += 1
        end = strict_list[s]
        if end > mid or end > high:
            while loose_list[l] < mid and loose_list[l] < n:
                l += 1
            end = min(loose_list[l], high) if loose_list[l] >= mid else high
        end = min(end, high)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks_of(text: str | None, minimum: int, normal: int, maximum: int) -> dict[int, int]:
    """From digest to length in bytes, each chunk once."""
    if not text:
        return {}
    data = text.encode("utf-8", "surrogatepass")
    out, at = {}, 0
    for end in boundaries(np.frombuffer(data, dtype=np.uint8), minimum, normal, maximum):
        out[xxhash.xxh3_64_intdigest(data[at:end])] = end - at
        at = end
    return out


def _chunks(docs: DataFrame, id_col: str, text_col: str, minimum: int, normal: int, maximum: int) -> DataFrame:
    """(__id, __d: digest, __w: length, __t: the length of all the row's chunks), a row for each distinct chunk of a row's text."""
    if not 0 < minimum <= normal <= maximum < 1 << LENGTH_BITS:
        raise ValueError("chunk lengths must rise from the least to the most")

    @F.pandas_udf("struct<d:array<long>,w:array<int>,t:long>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [chunks_of(text, minimum, normal, maximum) for text in texts]
            digests = [np.fromiter(f.keys(), dtype=np.uint64, count=len(f)).view(np.int64) for f in found]
            sizes = [np.fromiter(f.values(), dtype=np.int32, count=len(f)) for f in found]
            yield pd.DataFrame({"d": digests, "w": sizes, "t": [int(w.sum()) for w in sizes]})

    text = F.col(text_col)
    each = docs.where(F.length(text) > 0).select(F.col(id_col).alias("__id"), chunk(text).alias("__c"))
    each = each.select("__id", F.col("__c.t").alias("__t"), F.explode(F.arrays_zip("__c.d", "__c.w")).alias("__c"))
    return each.select("__id", F.col("__c.d").alias("__d"), F.col("__c.w").cast("long").alias("__w"), "__t")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", minimum: int = 128, normal: int = 512, maximum: int = 2048) -> DataFrame:
    """(id, digest, n_bytes): one row for each distinct chunk of each row's text. Nothing is shuffled."""
    digest, size = named(id_col, ("digest", "n_bytes"))
    each = _chunks(docs, id_col, text_col, minimum, normal, maximum)
    return each.select(F.col("__id").alias(id_col), F.col("__d").alias(digest), F.col("__w").cast("int").alias(size))


def _block(rows: list[tuple], source: bool) -> dict:
    """Classes as arrays: their numbers, and (source) the lengths of their members, or else how many those are; their chunks by class, or by digest."""
    numbers, members, sizes, digests, weights = zip(*rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(d) for d in digests])
    digest = np.concatenate(digests).astype(np.int64)
    if source:
        n, k, extra = np.concatenate(sizes).astype(np.int64), np.array([len(x) for x in sizes], dtype=np.int32), np.concatenate(weights).astype(np.int64)
    else:
        n, k = np.array(members, dtype=np.int64), np.empty(0, dtype=np.int32)
        order = np.argsort(digest, kind="stable")
        of = of[order]
        digest, first = np.unique(digest[order], return_index=True)
        extra = np.append(first, len(of)).astype(np.int64)
    return {"source": source, "no": np.array(numbers, dtype=np.int64).tobytes(), "n": n.tobytes(), "k": k.tobytes(), "d": digest.tobytes(), "c": of.tobytes(), "x": extra.tobytes()}


_BLOCK = "source boolean, no binary, n binary, k binary, d binary, c binary, x binary"


def _shared(left: dict, right: dict, min_containment: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, class, shared weight), by source, of two blocks' pairs that reach the containment for the shortest member; a class does not meet itself."""
    shortest = left["n"][np.cumsum(left["k"]) - left["k"]]
    at = np.minimum(np.searchsorted(right["d"], left["d"]), len(right["d"]) - 1)
    hit = right["d"][at] == left["d"]
    at, source, weight = at[hit], left["c"][hit], left["x"][hit]
    if not len(at):
        return
    begin, times = right["x"][at], right["x"][at + 1] - right["x"][at]
    wide = len(right["no"])
    ends = np.append(np.flatnonzero(np.diff(source)) + 1, len(source))  # of each source's hits
    entries = np.cumsum(times)[ends - 1]
    k = lo = done = 0
    while k < len(ends):
        k = max(int(np.searchsorted(entries, done + most, "right")), k + 1)
        done, hi = entries[k - 1], int(ends[k - 1])
        t, low = times[lo:hi], int(source[lo])
        place = np.repeat(begin[lo:hi] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        key = np.repeat(source[lo:hi].astype(np.int64) - low, t) * wide + right["c"][place]
        w = np.repeat(weight[lo:hi], t)
        cells = (int(source[hi - 1]) - low + 1) * wide
        if cells <= 8 * len(key):
            total = np.bincount(key, weights=w, minlength=cells)
            key = np.flatnonzero(total)
            total = total[key].astype(np.int64)
        else:
            both = np.sort(key << LENGTH_BITS | w)
            key = both >> LENGTH_BITS
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, total = key[first], np.add.reduceat(both & ((1 << LENGTH_BITS) - 1), first)
        a, b = key // wide + low, key % wide
        keep = (total >= min_containment * shortest[a]) & (left["no"][a] != right["no"][b])
        yield a[keep], b[keep], total[keep]
        lo = hi


class _Classes:
    """The classes of the documents, what they are joined with, and how they meet."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, min_containment: float, minimum: int, normal: int, maximum: int) -> None:
        self.min_containment = min_containment
        with shuffles_dropped(docs.sparkSession):
            rows = _chunks(docs.where(F.col(id_col).isNotNull()), id_col, text_col, minimum, normal, maximum)
            if not docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).count().where("count > 1").isEmpty():
                rows = rows.select("__id", "__d", "__w").distinct()
                rows = cut(rows.join(rows.groupBy("__id").agg(F.sum("__w").alias("__t")), "__id"))
            packed = rows.select("__id", "__d", F.shiftleft("__t", LENGTH_BITS).bitwiseOR(F.col("__w")).alias("__tw"))
            held = cut(packed.groupBy("__d").agg(F.count("*").alias("__n")).where("__n > 1"))
            weight, whole = F.col("__tw").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)), F.shiftright("__tw", LENGTH_BITS)
            chunk = F.struct("__d", weight.cast("int").alias("__w"))
            each = lookup(packed, held, ["__d"]).groupBy("__id").agg(F.sort_array(F.collect_list(chunk)).alias("__chunks"), F.sum(weight).alias("__s"), F.max(whole).alias("__t"))

            sets = ["__h", "__g", "__k", "__s"]  # a digest of 128 bits, the number and the weight of the shared chunks
            digests = F.col("__chunks.__d")
            each = cut(each.select("*", F.xxhash64(digests).alias("__h"), F.xxhash64(F.lit(1), digests).alias("__g"), F.size("__chunks").alias("__k")), held)
            classes = each.groupBy(*sets).agg(F.count("*").alias("__n"), F.min("__id").alias("__class"), F.sort_array(F.collect_set("__t")).alias("__sizes"))
            self.classes = cut(classes.withColumn("__no", F.monotonically_increasing_id()))
            self.members = lookup(each.select("__id", "__t", *sets), self.classes.select(*sets, "__n", "__class", "__no"), sets)
            heads = self.classes.select(F.col("__class").alias("__id"), "__no", "__n", "__sizes", "__s")
            of_class = each.select("__id", digests.alias("__d"), F.col("__chunks.__w").alias("__w")).join(heads, "__id")

            def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                open_, chunks = {False: [], True: []}, {False: 0, True: 0}
                for batch in batches:
                    for no, n, sizes, digest, weights, s in zip(*(batch[c] for c in ("__no", "__n", "__sizes", "__d", "__w", "__s"))):
                        for source in (False, True):
                            if not source or s >= min_containment * sizes[0]:
                                open_[source].append((no, n, sizes, digest, weights))
                                chunks[source] += len(digest)
                                if chunks[source] >= (max(1, part // 4) if source else part):
                                    yield pd.DataFrame([_block(open_[source], source)])
                                    open_[source], chunks[source] = [], 0
                for source in (False, True):
                    if open_[source]:
                        yield pd.DataFrame([_block(open_[source], source)])

            part = PART
            self.blocks = cut(of_class.mapInPandas(pack, _BLOCK))

    def met(self, counted: bool) -> DataFrame:
        """(__no, __other, __shared): the links, or (__no, __t, __links): how many documents of other classes contain a member of __t bytes, in parts to be added."""
        min_containment, most = self.min_containment, ENTRIES
        types = {"no": np.int64, "n": np.int64, "k": np.int32, "d": np.int64, "c": np.int32, "x": np.int64}

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    left, right = ({c: np.frombuffer(row[side + c], dtype=t) for c, t in types.items()} for side in ("l_", "r_"))
                    ends = np.cumsum(left["k"])
                    for a, b, shared in _shared(left, right, min_containment, most):
                        if not counted:
                            yield pd.DataFrame({"__no": left["no"][a], "__other": right["no"][b], "__shared": shared})
                            continue
                        order = np.lexsort((shared, a))
                        a, b, shared = a[order], b[order], shared[order]
                        sources, first = np.unique(a, return_index=True)
                        out = []
                        for i, lo, hi in zip(sources.tolist(), first.tolist(), [*first[1:].tolist(), len(a)]):
                            sizes = left["n"][ends[i] - left["k"][i] : ends[i]]
                            beyond = np.append(np.cumsum(right["n"][b[lo:hi]][::-1])[::-1], 0)
                            out.append((i, sizes, beyond[np.searchsorted(shared[lo:hi], min_containment * sizes)]))
                        if out:
                            no = np.repeat(left["no"][[i for i, _, _ in out]], [len(s) for _, s, _ in out])
                            yield pd.DataFrame({"__no": no, "__t": np.concatenate([s for _, s, _ in out]), "__links": np.concatenate([n for _, _, n in out])})

        side = lambda source, p: self.blocks.where(F.col("source") == source).select(*(F.col(c).alias(p + c) for c in types))
        both = side(True, "l_").hint("shuffle_replicate_nl").crossJoin(side(False, "r_"))
        return both.mapInPandas(meet, "__no long, __t long, __links long" if counted else "__no long, __other long, __shared long")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_containment: float = 0.5, minimum: int = 128, normal: int = 512, maximum: int = 2048) -> DataFrame:
    """(id, class_id, n_bytes, n_links): each document that shares a chunk, its class, the length of its chunks, and how many other documents contain it, copies among them."""
    found = _Classes(docs, id_col, text_col, min_containment, minimum, normal, maximum)
    one_by_one = setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is two blocks
    with shuffles_dropped(docs.sparkSession), one_by_one:
        counts = cut(found.met(True).groupBy("__no", "__t").agg(F.sum("__links").alias("__links")).where("__links > 0"))
    own = F.when(F.col("__s") >= F.lit(min_containment) * F.col("__t"), F.col("__n") - 1).otherwise(0)
    told = found.members.join(counts, ["__no", "__t"], "left")
    columns = named(id_col, ("class_id", "n_bytes", "n_links"))
    return told.select("__id", "__class", "__t", own + F.coalesce("__links", F.lit(0))).toDF(id_col, *columns)


def containment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_containment: float = 0.5, minimum: int = 128, normal: int = 512, maximum: int = 2048) -> DataFrame:
    """(id, class_id, n_bytes, contained_in, shared_bytes, containment): the classes' members and the links between classes.

    Where contained_in is null, the row says that the document is of that class and that
    its chunks have n_bytes. The other rows are links, from the class class_id (whose
    smallest id is repeated in the id column, and the least n_bytes of a member in n_bytes)
    to the class contained_in: every member whose n_bytes are at most shared_bytes /
    min_containment is contained, to the part shared_bytes / n_bytes, in all other members
    of contained_in. containment is that part for the shortest member, the largest. A class
    is linked to itself if it has several members.
    """
    found = _Classes(docs, id_col, text_col, min_containment, minimum, normal, maximum)
    classes, members, least = found.classes, found.members, F.col("__sizes")[0].alias("__least")
    one = classes.select("__no", F.col("__class").alias("__id"), least)
    other = classes.select(F.col("__no").alias("__other"), F.col("__class").alias("__held"))
    linked = found.met(False).join(one, "__no").join(other, "__other").select("__id", F.col("__held").alias("__other"), "__shared", "__least")
    within = classes.where("__n > 1").select(F.col("__class").alias("__id"), F.col("__class").alias("__other"), F.col("__s").alias("__shared"), least)
    links = linked.unionByName(within.where(F.col("__shared") >= F.lit(min_containment) * F.col("__least")))

    kind = type_of(docs, id_col)
    columns = named(id_col, ("class_id", "n_bytes", "contained_in", "shared_bytes", "containment"))
    nothing = [F.lit(None).cast(t) for t in (kind, "long", "double")]
    told = members.select("__id", F.col("__class"), F.col("__t"), *nothing)
    linked = links.select("__id", F.col("__id"), F.col("__least"), F.col("__other"), F.col("__shared"), F.col("__shared") / F.col("__least"))
    return told.toDF(id_col, *columns).unionByName(linked.toDF(id_col, *columns))
