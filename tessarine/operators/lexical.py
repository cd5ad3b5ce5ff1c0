"""Lexical retrieval: postings, BM25, pseudo-relevance expansion, learned-sparse products.

Without an index a query costs two narrow scans: one aggregates the statistics of its
terms to a single row, one scores and keeps the top. Nothing but that row and the top
leaves the scan's tasks. With an index (:func:`build_index`) it reads the term
partitions of its terms alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_of

K1, B = 1.2, 0.75
MOST_TERMS, MOST_SPARSE = 32, 256
SEISMIC_CUT = 512
FILE_TOKENS = 1_000_000


@dataclass(frozen=True)
class Stats:
    """n documents, their mean length, and how many hold each of the query's terms."""

    n: int
    mean_length: float
    df: dict[str, int]

    def idf(self, term: str) -> float:
        return math.log((self.n - self.df[term] + 0.5) / (self.df[term] + 0.5) + 1.0)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): one row for each term of each document; null texts have none."""
    each = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    terms = each.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf")).select("term", "id", "tf", "dl")


def _counts(toks: Column) -> Column:
    """The terms of an array of tokens, ordered, as an array of (term, tf): the runs of the sorted tokens. Null for null.

    A lambda over an array of one item gives it a name: the sorted tokens and the starts of their runs are made once.
    """

    def named(item: Column, use) -> Column:
        return F.transform(F.array(item), use)[0]

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when(~t.eqNullSafe(F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return named(starts, lambda p: F.transform(p, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s)) - at).alias("tf"))))

    return named(F.sort_array(toks), runs)


def build_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", buckets: int = 64, file_tokens: int = FILE_TOKENS) -> None:
    """Write postings by hash of the term, sorted by term within files, and the corpus totals.

    A bucket is cut by hash of the id into as many files as keep the mean of tokens in a file
    below ``file_tokens``: a task sorts one file, so its memory doesn't grow with the corpus.
    """
    length = F.coalesce(F.size(tokens(F.col(text_col))), F.lit(0))
    totals = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(length, F.lit(0))), F.lit(0)).alias("total_length"), F.lit(buckets).alias("buckets"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    cuts = max(1, math.ceil(docs.sparkSession.read.parquet(f"{path}/totals").first()["total_length"] / (buckets * file_tokens)))
    once = docs.select(F.col(id_col).alias("id"), F.explode(F.array(tokens(F.col(text_col)))).alias("t"))
    each = once.select("id", F.size("t").alias("dl"), F.explode(_counts(F.col("t"))).alias("p")).select("p.term", "id", "p.tf", "dl")
    file = bucket_of(F.col("term"), buckets) * cuts + F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int")
    # all rows of a term and an id are in one file, so those of repeated ids are added up there
    out = each.withColumn("file", file).repartitionById(buckets * cuts, "file").groupBy("file", "term", "id", "dl").agg(F.sum("tf").cast("int").alias("tf"))
    out = out.select("term", "id", "tf", "dl", F.floor(F.col("file") / cuts).cast("int").alias("bucket"))
    out.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): how many documents hold each term."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def merge_frequencies(parts: list[DataFrame]) -> DataFrame:
    """The (term, df) tables of disjoint corpora as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term").agg(F.sum("df").alias("df"))


def _count_of(array: Column, item: str) -> Column:
    return F.size(F.filter(array, lambda x: x == item))


def _hits(docs: DataFrame, keep: list[Column], text_col: str, terms: list[str]) -> DataFrame:
    """``keep``, __dl: the number of tokens, and __hits: those of them that are among the terms.

    The tokens pass through a generator of one row, below which no expression on them is
    pushed: each text is tokenised once, however often its tokens are referred to.
    """
    once = docs.select(*keep, F.explode(F.array(tokens(F.col(text_col)))).alias("__tokens"))
    hits = F.filter("__tokens", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    return once.select(*keep, F.greatest(F.size("__tokens"), F.lit(0)).alias("__dl"), hits.alias("__hits"))


def statistics(docs: DataFrame, terms: list[str], text_col: str = "text") -> Stats:
    """One pass over the texts; the result is one row with a number for each term."""
    rows = _hits(docs, [], text_col, terms)
    totals = [F.count("*").alias("n"), F.coalesce(F.sum("__dl"), F.lit(0)).alias("total")]
    if len(terms) <= MOST_TERMS:
        row = rows.agg(*totals, *[F.count_if(F.array_contains("__hits", w)).alias(f"df{i}") for i, w in enumerate(terms)]).first()
        df = {w: row[f"df{i}"] for i, w in enumerate(terms)}
    else:
        row = rows.agg(*totals).first()
        some = rows.select(F.explode(F.array_distinct("__hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df = dict.fromkeys(terms, 0) | {r["term"]: r["df"] for r in some.collect()}
    return Stats(row["n"], row["total"] / max(row["n"], 1), df)


def kept_terms(terms: Counter, stats: Stats, most: int = MOST_TERMS) -> list[str]:
    """The query's terms that occur at all, the rarest ``most`` of them, ties by term."""
    found = [w for w in terms if stats.df.get(w)]
    return sorted(sorted(found, key=lambda w: (-stats.idf(w), w))[:most])


def bm25(
    docs: DataFrame, query: str | list[str], id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, corpus: DataFrame | None = None, keep_all: bool = False
) -> DataFrame:
    """(id_col, score) of every document that holds a term of the query; with ``keep_all`` all columns and the score.

    corpus: the table whose statistics count, ``docs`` by default; a filtered ``docs``
    keeps the scores of the whole corpus. Null texts count as empty documents. No terms:
    no rows.
    """
    terms = Counter(tokens_of(query) if isinstance(query, str) else query)
    stats = statistics(corpus if corpus is not None else docs, sorted(terms), text_col)
    keep = kept_terms(terms, stats)
    columns = [F.col(c) for c in docs.columns if c.lower() != "score"] if keep_all else [F.col(id_col)]
    if not keep:
        return docs.select(*columns, F.lit(0.0).alias("score")).where(F.lit(False))
    # rows without any of the terms are passed over before they are tokenised
    near = docs.where(F.col(text_col).rlike("(?i)" + "|".join(keep)))
    rows = _hits(near, columns, text_col, keep).where(F.size("__hits") > 0)
    score, scale = F.lit(0.0), max(stats.mean_length, 1.0)
    for w in keep:
        score = score + _term_score(_count_of(F.col("__hits"), w), F.col("__dl"), terms[w], stats.idf(w), k1, b, scale)
    return rows.select(*columns, score.alias("score"))


def _term_score(tf: Column, dl: Column, qf: int, idf: float, k1: float, b: float, scale: float) -> Column:
    norm = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * dl / F.lit(scale))
    return F.lit(qf * idf) * tf * F.lit(k1 + 1.0) / (tf + norm)


def bm25_indexed(spark, path: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) from a written index; partitions and row groups without the terms are not read.

    Scores are rounded to 12 places, so that equal documents tie in whatever order terms are added.
    """
    terms = Counter(tokens_of(query))
    totals = spark.read.parquet(f"{path}/totals").first()
    wanted = sorted(terms)
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted] or [("",)], "w string").select(bucket_of(F.col("w"), totals["buckets"])).collect()]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    stats = Stats(totals["n"], totals["total_length"] / max(totals["n"], 1), df)
    keep = kept_terms(terms, stats)
    if not keep:
        return hits.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    weight = F.element_at(F.create_map(*[F.lit(x) for w in keep for x in (w, terms[w] * stats.idf(w))]), F.col("term"))
    norm = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * F.col("dl") / F.lit(max(stats.mean_length, 1.0)))
    return hits.where(F.col("term").isin(keep)).groupBy("id").agg(F.round(F.sum(weight * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)), 12).alias("score"))


def expanded_query(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", feedback: int = 3, k1: float = K1, b: float = B) -> list[str]:
    """The query's terms, then those of more than 3 bytes of its best documents, each once, in order of appearance."""
    best = bm25(docs.select(id_col, text_col), query, id_col, text_col, k1, b, keep_all=True).orderBy(F.desc("score"), id_col).limit(feedback)
    long = F.filter(F.array_distinct(tokens(F.col(text_col))), lambda t: F.octet_length(t) > 3)
    out = dict.fromkeys(tokens_of(query))
    for row in best.select(id_col, "score", long.alias("__long")).orderBy(F.desc("score"), id_col).collect():
        out |= dict.fromkeys(row["__long"])
    return list(out)


def sparse_weights(text: Column) -> Column:
    """A map from each token to its count as a float: weights where a model gives none. Null for null."""
    return F.map_from_entries(F.transform(_counts(tokens(text)), lambda c: F.struct(c["term"], c["tf"].cast("float"))))


def with_sparse_weights(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, sparse): the maps of :func:`sparse_weights`, made once for each row behind a generator, as in :func:`_hits`."""
    return docs.select(F.col(id_col), F.explode(F.array(sparse_weights(F.col(text_col)))).alias("sparse"))


def _query_map(weights: dict[str, float]) -> dict[str, float]:
    return dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:MOST_SPARSE])


def splade(docs: DataFrame, weights: dict[str, float], id_col: str = "id", sparse_col: str = "sparse", keep_all: bool = False) -> DataFrame:
    """(id_col, score), or all columns and the score: the product of the weights over shared tokens; a map-only scan."""
    query = _query_map(weights)
    columns = [F.col(c) for c in docs.columns if c.lower() != "score"] if keep_all else [F.col(id_col)]
    if not query:
        return docs.select(*columns, F.lit(0.0).alias("score")).where(F.lit(False))
    total = F.lit(0.0)
    for token, weight in sorted(query.items()):
        total = total + F.coalesce(F.element_at(F.col(sparse_col), token).cast("double"), F.lit(0.0)) * F.lit(float(weight))
    hit = F.arrays_overlap(F.map_keys(F.col(sparse_col)), F.lit(list(query)))
    return docs.where(hit).select(*columns, total.alias("score"))


def seismic(docs: DataFrame, weights: dict[str, float], id_col: str = "id", sparse_col: str = "sparse", cut: int = SEISMIC_CUT) -> DataFrame:
    """As :func:`splade`, over the ``cut`` documents of largest weight of each token, ties by id.

    The cut is pushed below the shuffle as a local limit for each token.
    """
    query = _query_map(weights)
    entries = F.filter(F.map_entries(F.col(sparse_col)), lambda e: e["key"].isin(*query) if query else F.lit(False))
    each = docs.select(F.col(id_col), F.explode(entries).alias("e")).select(F.col(id_col), F.col("e.key").alias("term"), F.col("e.value").cast("double").alias("w"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), id_col))).where(F.col("r") <= cut)
    if not query:
        return ranked.select(F.col(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(query.items()) for x in (k, float(v))]), F.col("term"))
    return ranked.groupBy(id_col).agg(F.sum(F.col("w") * weight).alias("score"))
