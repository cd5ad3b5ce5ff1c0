"""URL filtering by association rules.

A URL becomes a set of tokens: scheme, host, the host's labels and their hyphenated
words, path segments, query keys and fragment, each with a prefix that names its place;
numbers become ``#``. Spark's FP-growth mines, from labelled URLs, the token sets that
occur with the bad label. A rule "tokens imply bad" stays if its confidence and support
reach the limits, and if no rule on a subset of its tokens is at least as confident.

Two kinds of tokens are settled before mining, as every set with them would only be
pruned afterwards. A token that no good URL has is a rule of its own with confidence 1,
so no larger set with it can stay. Tokens that occur in exactly the same labelled URLs
stand for each other; the shortest, of equally short ones the alphabetically first,
represents them. What is left is mined without a bound on the size of a set. The work is exponential in the number of
such tokens, neither pure nor alike, that ``min_bad`` bad URLs have in common.

Rules match by inverted index: each rule is filed under the token that is rarest among
the URLs, pages' tokens are looked up there, and the rest of a rule's tokens is checked
by array containment.

Defined results
---------------
* null or empty URLs have no tokens: not matched by any rule.
* labelled rows with null label are not used for mining; with none left, or no bad one,
  there are no rules.
* several matching rules: the most confident one is reported, then the one with the
  larger support, then the alphabetically first.
* repeated rows each get a row. Empty tables give empty results.
* extra columns are kept by :func:`flag`; columns named like its results are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

BAD = "label=bad"


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a URL; an empty array for null and empty ones."""
    low = F.lower(F.trim(url))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"#(.*)$", 1)

    def tagged(tag: str, items: Column) -> Column:
        plain = F.transform(items, lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
        return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.concat(F.lit(tag + ":"), x))

    labels = F.split(host, r"\.")
    words = F.filter(F.split(host, r"[.-]"), lambda x: F.length(x) > 2)
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    all_of = F.concat(tagged("scheme", F.array(scheme)), tagged("host", F.array(host)), tagged("label", labels), tagged("word", words), tagged("path", F.split(path, "/")), tagged("key", keys), tagged("fragment", F.array(fragment)))
    return F.coalesce(F.array_sort(F.array_distinct(all_of)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.002, min_confidence: float = 0.6, min_bad: int = 5) -> DataFrame:
    """(tokens, confidence, support, n_bad): the rules that stay after pruning.

    min_support: the least share of labelled rows that have the tokens and are bad.
    min_bad: the least number of such rows, so that small tables give no chance rules.

    The rows that are mined are the bad ones (a rule's support is theirs alone); how
    often a rule's tokens occur at all is then counted over all labelled rows.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double, n_bad long")
    rows = labelled.where(F.col(bad_col).isNotNull() & (F.length(url_col) > 0)).select(tokens_of(F.col(url_col)).alias("tokens"), F.col(bad_col).cast("boolean").alias("bad"))
    bad_rows = rows.where("bad").select("tokens")
    rows = cut(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")))  # a row for each token set
    total, n_bad = rows.agg(F.sum("n"), F.sum("n_bad")).first()
    least = max(min_support * (total or 0), min_bad)
    if not n_bad or n_bad < least:
        return empty

    each = rows.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("h"), F.xxhash64("tokens", F.lit(1)).alias("g"), "n", "n_bad")
    tokens = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    alike = tokens.where(F.col("n_bad") >= least).groupBy("n", "n_bad", "h", "g").agg(F.min(F.struct(F.length("token"), "token")).alias("t"))
    alike = cut(alike.select(F.col("t.token"), "n", "n_bad"))
    pure = alike.where("n = n_bad").select(F.array("token").alias("items"), "n_bad", "n")

    # at most the mean number of tokens of a URL, over min_support, are frequent enough
    left = [r["token"] for r in alike.where("n > n_bad").select("token").collect()]
    mixed = cut(bad_rows.select(F.array_intersect("tokens", F.array(*map(F.lit, left)).cast("array<string>")).alias("items")).where("size(items) > 0"))
    n_mixed = mixed.count()
    found = pure
    if n_mixed >= least:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_mixed), minConfidence=1.0).fit(mixed).freqItemsets
        sets = cut(sets.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")))
        seen = _matches(rows.select("tokens", "n"), sets).groupBy("items").agg(F.sum("n").alias("n"))
        found = pure.unionByName(sets.join(seen, "items"))
    rules = found.select(F.col("items").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(total)).alias("support"), "n_bad")
    rules = cut(rules.where(F.col("confidence") >= min_confidence))
    parts = _matches(rules.select("tokens", "confidence"), rules.select(F.col("tokens").alias("items")))
    parts = parts.where(F.size("items") < F.size("tokens")).join(rules.select(F.col("tokens").alias("items"), F.col("confidence").alias("c")), "items")
    return rules.join(parts.where(F.col("c") >= F.col("confidence")).select("tokens").distinct(), "tokens", "left_anti")


def _matches(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows x sets whose items the row's tokens hold, by an index on the item of each set that is rarest in the rows."""
    common = sets.select("items", F.explode("items").alias("i"))
    often = rows.select(F.explode("tokens").alias("i")).groupBy("i").agg(F.count("*").alias("f"))
    rarest = common.join(often, "i").groupBy("items").agg(F.min(F.struct("f", "i")).alias("r"), F.count("*").alias("k"))
    index = rarest.where(F.col("k") == F.size("items")).select("items", F.col("r.i").alias("token"))
    probe = rows.select("*", F.explode("tokens").alias("token"))
    return probe.join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0).drop("token")


def flag(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with matched_rule (tokens or null), rule_confidence, rule_support and blocked.

    Pages with equal token sets are matched once: the sets are far fewer than the pages.
    """
    made = ("matched_rule", "rule_confidence", "rule_support", "blocked")
    plain = pages.drop(*[c for c in pages.columns if c.lower() in made])
    key = free(plain, "__tokens")
    tagged = plain.withColumn(key, tokens_of(F.col(url_col)))
    sets = tagged.select(F.col(key).alias("tokens")).distinct()
    hits = _matches(sets, rules.select(F.col("tokens").alias("items")))
    hits = hits.join(rules.select(F.col("tokens").alias("items"), "confidence", "support"), "items")
    order = F.struct(-F.col("confidence"), -F.col("support"), "items")
    best = hits.groupBy("tokens").agg(F.min_by(F.struct("items", "confidence", "support"), order).alias("__b"))
    best = best.select(F.col("tokens").alias(key), F.col("__b.items").alias("matched_rule"), F.col("__b.confidence").alias("rule_confidence"), F.col("__b.support").alias("rule_support"))
    return tagged.join(best, key, "left").withColumn("blocked", F.col("matched_rule").isNotNull()).drop(key)
