"""Language identification by word-first backoff.

Every word of a text votes with the negative decimal logarithm of its relative
frequency in each language. A word that no language model has is scored by its
character n-grams, longest first: if any of its 5-grams is known, the mean over the
known ones counts, else the 4-grams are tried, and so on down to single characters.
A language that lacks a word or n-gram that another language has gets ``penalty``.
The text goes to the language with the lowest mean score.

Fitting uses a bounded sample of the labelled rows (``sample_per_language``);
scoring runs over all rows and whole texts.

Defined results
---------------
* null text, empty text, or a text without letters: language null, score null,
  0 words, not accepted.
* ties between languages: the alphabetically first language wins, margin 0, not accepted, as
  languages within ``min_margin`` of each other cannot be told apart.
* one language in the model: margin null.
* repeated rows: each gets its own (equal) result row.
* an empty table gives an empty result; fitting on no labelled rows raises ValueError.
* extra columns are ignored by :func:`identify`; :func:`keep_accepted` keeps them all.
* labelled rows with null text or null language are not used for fitting.
* very long texts are scored whole. Sums run in the order in which a text's words first
  occur, so equal texts have equal scores whatever a worker has scored before.
* a result column that is called like the id column gets an underscore.

``min_margin`` is in decimal digits of likelihood a word. Choose it from labelled rows, as
the margin that a chosen share of them falls short of; the default suits long prose in
languages that share few words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, unit_interval

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Scores that are kept per worker between batches; a matter of speed alone.
KEPT_WORDS = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class BackoffModel:
    """languages: sorted; words and grams[n-1]: to the row of ``table`` with a score per language."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    table: np.ndarray
    penalty: float
    memo: "Memo" = field(default=None, repr=False, compare=False)

    def word_scores(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is not None:
            return self.table[row]
        for n in range(LONGEST, 0, -1):
            known = self.grams[n - 1]
            rows = [known[g] for g in grams_of(word, n) if g in known]
            if rows:
                return self.table[rows].mean(axis=0)
        return np.full(len(self.languages), self.penalty)


class Memo(dict):
    """From word to row of scores, filled as words come."""

    def __init__(self, model: BackoffModel):
        super().__init__()
        self.model = model
        self.rows = np.empty((1 << 12, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at] = self.model.word_scores(word)
        self[word] = at
        return at


def fit(rows: list[tuple[str, str]], min_count: int = 2, penalty: float = 7.0) -> BackoffModel:
    """Fit on (text, language) pairs; n-grams and words seen less than ``min_count`` times don't count."""
    counts: dict[str, Counter] = {}
    for text, language in rows:
        if text is not None and language is not None:
            counts.setdefault(language, Counter()).update(words_of(text))
    languages = sorted(k for k, c in counts.items() if c)
    if not languages:
        raise ValueError("no labelled rows to fit on")
    scores: list[np.ndarray] = []

    def collect(per_language: list[Counter]) -> dict[str, int]:
        rows_of: dict[str, int] = {}
        for at, counter in enumerate(per_language):
            total = sum(counter.values())
            for item, n in counter.items():
                if n >= min_count:
                    if item not in rows_of:
                        rows_of[item] = len(scores)
                        scores.append(np.full(len(languages), penalty))
                    scores[rows_of[item]][at] = min(penalty, -np.log10(n / total))
        return rows_of

    words = collect([counts[k] for k in languages])
    grams = []
    for n in range(1, LONGEST + 1):
        per_language = []
        for k in languages:
            counter: Counter = Counter()
            for word, c in counts[k].items():
                for g in grams_of(word, n):
                    counter[g] += c
            counter.pop(" ", None)
            per_language.append(counter)
        grams.append(collect(per_language))
    return BackoffModel(languages, words, grams, np.array(scores).reshape(-1, len(languages)), penalty)


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 500, min_count: int = 2, penalty: float = 7.0) -> BackoffModel:
    """Fit on about ``sample_per_language`` texts of each language, chosen by a hash of the whole text.

    The driver holds that sample, whose size does not grow with the table: equal texts
    enter once. Languages with fewer rows are used whole. ``id_col`` is not used.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        raise ValueError("no labelled rows to fit on")
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col(lang_col) == language, F.lit(min(1.0, sample_per_language / n))).otherwise(share)
    chosen = labelled.where(unit_interval(F.col(text_col)) < share).groupBy(F.col(lang_col).alias("__lang"), F.xxhash64(text_col).alias("__hash"))
    sample = chosen.agg(F.min(text_col).alias("__text")).select("__text", "__lang").collect()
    return fit([(r[0], r[1]) for r in sorted(sample, key=lambda r: (r[1], r[0]))], min_count, penalty)


def score_texts(model: BackoffModel, texts: list[str | None], max_score: float, min_margin: float, languages: list[str] | None = None) -> pd.DataFrame:
    """One row per text: language, score, margin, n_words, accepted."""
    if model.memo is None or len(model.memo) > KEPT_WORDS:
        model.memo = Memo(model)
    memo = model.memo
    n_lang = len(model.languages)
    best, score, margin, n_words = [None] * len(texts), np.full(len(texts), np.nan), np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
    for at, text in enumerate(texts):
        found = words_of(text) if text else []
        if not found:
            continue
        counts = Counter(found)  # in the order of first occurrence, so that sums do not depend on what was seen before
        rows = np.fromiter(map(memo.__getitem__, counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        mean = (memo.rows[rows] * times[:, None]).sum(axis=0) / len(found)
        win = int(mean.argmin())
        best[at], score[at], n_words[at] = model.languages[win], mean[win], len(found)
        if n_lang > 1:
            margin[at] = np.partition(mean, 1)[1] - mean[win]
    accepted = (n_words > 0) & (np.nan_to_num(score, nan=np.inf) <= max_score) & (np.isnan(margin) | (margin >= min_margin))
    if languages is not None:
        accepted &= np.array([b in languages for b in best], dtype=bool)
    return pd.DataFrame({"language": pd.Series(best, dtype=object), "score": score, "margin": margin, "n_words": n_words, "accepted": accepted})


SCHEMA = "language string, score double, margin double, n_words long, accepted boolean"


def verdict(docs: DataFrame, model: BackoffModel, text_col: str = "text", max_score: float = 6.0, min_margin: float = 0.15, languages: list[str] | None = None) -> Column:
    """The verdict on the text as a struct column; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = score_texts(shared.value, texts.tolist(), max_score, min_margin, languages)
            yield out.astype({"score": "Float64", "margin": "Float64"})

    return judge(F.col(text_col))


def identify(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: the id and the verdict's fields (:data:`SCHEMA`)."""
    fields = tuple(f.split()[0] for f in SCHEMA.split(", "))
    judged = docs.select(F.col(id_col).alias("__id"), verdict(docs, model, text_col, **limits).alias("__verdict"))
    return judged.select(F.col("__id").alias(id_col), *[F.col(f"__verdict.{f}").alias(n) for f, n in zip(fields, named(id_col, fields))])


def keep_accepted(docs: DataFrame, model: BackoffModel, text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text is accepted, with their columns as they are."""
    return docs.where(verdict(docs, model, text_col, **limits)["accepted"])
