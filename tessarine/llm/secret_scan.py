"""Secret scanning by password guess cost.

A value in a credential context (``password=...``, ``api_key: "..."``, ``DB_PASS = ...``,
``Authorization: Bearer ...``, ``<password>...</password>``) is a secret if it is hard to
guess. Its cost, the decimal logarithm of the guesses an informed attacker needs, is that
of the cheapest way to cut it into

* dictionary words (log10 of the rank, plus log10 2 for capital letters and for each
  kind of look-alike character used),
* dates (days of a year, years from a reference year, separators),
* repeats of a unit of up to 32 characters (the unit's own cost, plus the number of
  decimal digits of the count),
* keyboard walks of at least 3 neighbouring keys (a start, then less for going straight
  on than for a turn),
* brute-force spans (one decimal digit a character),

and ``BREAK`` for each cut between two of them. The minimum is found by dynamic
programming over positions and is exact. Time is linear in the value's length.

A filter in the JVM finds the rows that have a credential context at all; only those
texts go to Python.

Defined results
---------------
* null or empty texts and texts without a credential context: no findings; redaction
  returns them unchanged (null stays null).
* a value is an XML element's text to the next tag or line end, the quoted string, or else
  the run up to white space, quote, comma, semicolon or closing bracket; empty values and
  values under ``min_length`` are no findings. White space is Unicode's, letter case ASCII's.
* ties between segmentations: the cost is the same; the one with the earliest kind in
  the order of the list above is reported.
* repeated rows each give their own findings. Empty tables give empty results.
* :func:`redact` keeps all columns, and changes the length column only where it masks;
  columns with internal names do not occur. A result column of :func:`scan` that is
  called like the id column gets an underscore.
* very long values are scored whole.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

WORDLIST = "/opt/tokenizers/word_bpe_49k.json"
_NAMES = (
    "password|passwd|passphrase|pwd|secret|token|api[ _-]?key|apikey|(?:access|auth|private|encryption|signing|master|session|account|service|shared|storage|license)[ _-]?key"
    "|client[ _-]?secret|credentials?|authorization|(?<![a-z])(?:db|user|root|admin|smtp|ftp|sql)?pass(?![a-z])"
)
#: A name with the further parts of its identifier.
_NAME = rf"(?:{_NAMES})s?(?: ?(?:key|value|id|code|hash|string))?(?:[_.-][a-z0-9]+){{0,4}}"
#: White space for both engines: what Python's str calls white space, spelled out, as the JVM's \s is ASCII alone.
_WS = r"\t-\r\x1c-\x20\x85   -     　"
_ELEMENT = rf"<[A-Za-z0-9_:.-]{{0,40}}?{_NAME}(?:[{_WS}][^<>]{{0,200}})?>"
_ASSIGNED = rf"{_NAME}[\"']?\]?[{_WS}]*(?:=>|:=|=|:)[{_WS}]*"
#: The context, for the JVM's and for Python's regular expressions alike: an XML element, or an assignment or header.
#: Both fold the case of ASCII letters only, and neither uses a class that means more in one of them.
CONTEXT = rf"(?i)(?:{_ELEMENT}|{_ASSIGNED})"
_VALUE = rf"(?:(?:bearer|basic|digest|token)[ \t]+(?=[^{_WS}\"',;)\]}}>]))?(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^{_WS}\"',;)\]}}>]+))"
FINDING = re.compile(rf"{_ELEMENT}[{_WS}]*([^<>\r\n]+)|{_ASSIGNED}{_VALUE}", re.I | re.A)
NAME = re.compile(_NAMES, re.I | re.A)

BREAK = math.log10(2)
PER_CHAR = 1.0
#: What 8 random characters cost: one decimal digit each.
MIN_COST = 8.0
WALK_START, WALK_ON, WALK_TURN = math.log10(47), math.log10(2), math.log10(6)
MAX_UNIT = 32
REFERENCE_YEAR = 2025
COMMON = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein shadow master 696969 mustang michael superman batman trustno1 "
    "admin welcome login princess solo passw0rd starwars changeme secret hunter2 example test default guest root user your here placeholder none null true false todo redacted sample dummy foobar"
).split()
_LEET = str.maketrans("430157$@!", "aeoistsai")
_SHIFTED = dict(zip('~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?', "`1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./"))
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_PLACE = {c: (x, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row) if c != " "}
#: Slanted neighbours: left, right, and two above and below each.
_STEPS = {(-1, 0), (1, 0), (0, -1), (1, -1), (-1, 1), (0, 1)}
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d))|(?=((?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\6(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
KINDS = ("word", "date", "repeat", "walk", "brute")


def load_words(path: str | None = WORDLIST) -> dict[str, int]:
    """Ranks from 1: common passwords, then the whole words of a public tokenizer's vocabulary in its order.

    path: a tokenizer file in JSON, or None for the common passwords alone. The list's
    size does not depend on the data.
    """
    ranked = list(COMMON)
    if path:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranked += [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 7]
    ranks: dict[str, int] = {}
    for word in ranked:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


class GuessCost:
    """cost(value) and parts(value); see the module's text."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.longest = max(map(len, words), default=0)
        self._unit = lru_cache(maxsize=4096)(lambda u: self.parts(u)[0])

    def word_cost(self, piece: str) -> float | None:
        low = piece.lower()
        plain = low.translate(_LEET)
        best = None
        for form in {low, plain}:
            rank = self.words.get(form)
            if rank is not None:
                kinds = len({a for a, b in zip(low, form) if a != b})
                cost = math.log10(rank) + BREAK * (kinds + (piece != low))
                best = cost if best is None else min(best, cost)
        return best

    @staticmethod
    def dates(value: str) -> Iterator[tuple[int, int, float]]:
        for m in _DATE.finditer(value):
            for whole, sep in ((1, 2), (3, 4), (5, 6)):
                if m.group(whole):
                    text = m.group(whole)
                    year = int(text[:4] if whole == 1 else text[-4:])
                    cost = math.log10(365 * max(abs(year - REFERENCE_YEAR), 20)) + (math.log10(4) if m.group(sep) else 0)
                    yield m.start(), m.start() + len(text), cost
        for m in _YEAR.finditer(value):
            yield m.start(), m.start() + 4, math.log10(max(abs(int(m.group(1)) - REFERENCE_YEAR), 20))

    def parts(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """The least cost, and the cuts (kind, start, end) that reach it."""
        n = len(value)
        if not n:
            return 0.0, []
        inf = math.inf
        best, back = [0.0] + [inf] * n, [None] * (n + 1)
        dates: dict[int, list[tuple[int, float]]] = {}
        for a, b, cost in self.dates(value):
            dates.setdefault(b, []).append((a, cost))
        brute, brute_from = inf, 0
        walk = []  # (length so far, 3 standing for more; cost; start) while keys adjoin
        last_key, last_step = None, None
        same = [0] * (MAX_UNIT + 1)
        windows: dict[tuple[int, int, int], deque] = {}
        for end in range(1, n + 1):
            c = value[end - 1]
            enter = best[end - 1] + (BREAK if end > 1 else 0.0)
            options = []
            for a in range(max(0, end - self.longest), end):
                cost = self.word_cost(value[a:end])
                if cost is not None:
                    options.append((best[a] + (BREAK if a else 0.0) + cost, 0, a))
            for a, cost in dates.get(end, ()):
                options.append((best[a] + (BREAK if a else 0.0) + cost, 1, a))
            for unit in range(1, min(MAX_UNIT, end - 1) + 1):
                if c != value[end - 1 - unit]:
                    if same[unit] >= unit:
                        for key in [k for k in windows if k[0] == unit]:
                            del windows[key]
                    same[unit] = 0
                    continue
                same[unit] += 1
                if same[unit] >= unit:
                    options += self._repeats(value, best, windows, same[unit], unit, end)
            place = _PLACE.get(_SHIFTED.get(c, c))
            step = (place[0] - last_key[0], place[1] - last_key[1]) if place and last_key else None
            if step in _STEPS:
                move = WALK_ON if step == last_step else WALK_TURN
                walk = [(min(k + 1, 3), cost + (WALK_TURN if k == 1 else move), a) for k, cost, a in walk]
            else:
                walk = []
                step = None
            if place:
                walk.append((1, enter + WALK_START, end - 1))
            long = min((w for w in walk if w[0] == 3), key=lambda w: w[1], default=None)
            walk = [w for w in walk if w[0] < 3] + ([long] if long else [])
            last_key, last_step = place, step
            if long:
                options.append((long[1], 3, long[2]))
            if enter < brute:
                brute, brute_from = enter, end - 1
            brute += PER_CHAR
            options.append((brute, 4, brute_from))
            best[end], kind, start = min(options)
            back[end] = (KINDS[kind], start)
        out, end = [], n
        while end:
            kind, start = back[end]
            out.append((kind, start, end))
            end = start
        return best[n], out[::-1]

    def _repeats(self, value, best, windows, run, unit, end):
        """Cuts whose last part is k >= 2 copies of the unit that ends here, the cheapest of each number of digits.

        Starts of one residue enter a deque of minima for each number of digits.
        """
        whole = self._unit(value[end - unit : end])
        copies = 1 + run // unit
        digits = 1
        while 10 ** (digits - 1) <= copies:
            key = (unit, end % unit, digits)
            queue = windows.get(key)
            newest = end - 2 * unit
            if queue is None:
                queue = windows[key] = deque()
                fresh = range(end - copies * unit, newest + 1, unit)
            else:
                fresh = (newest,)
            for a in fresh:
                cost = best[a] + (BREAK if a else 0.0)
                while queue and queue[-1][0] >= cost:
                    queue.pop()
                queue.append((cost, a))
            oldest = end - min(copies, 10**digits - 1) * unit
            while queue and queue[0][1] < oldest:
                queue.popleft()
            if queue:
                yield queue[0][0] + whole + digits, 2, queue[0][1]
            digits += 1


@lru_cache(maxsize=4)
def _scorer(path: str | None) -> GuessCost:
    return GuessCost(load_words(path))


def findings_of(text: str, scorer: GuessCost, min_length: int) -> Iterator[tuple[str, int, int, str, float, list]]:
    """(name, start, end, value, cost, parts) of each value in a credential context."""
    for m in FINDING.finditer(text):
        which = next(i for i in (1, 2, 3, 4) if m.group(i) is not None)
        value = m.group(which)
        if which == 1:
            value = value.rstrip()
        if which == 4:
            value = value.rstrip(".!?:")
        if len(value) >= min_length:
            cost, parts = scorer.parts(value)
            yield NAME.search(m.group(0)).group(0).lower(), m.start(which), m.start(which) + len(value), value, cost, parts


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, min_length: int = 4, wordlist: str | None = WORDLIST) -> DataFrame:
    """One row per credential value: id, name, start, end, log10_guesses, n_parts, kinds, is_secret.

    start and end count characters of the text. is_secret: the cost is at least min_cost.
    The value itself is not repeated in the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_words(wordlist))
    state: list[GuessCost] = []

    @F.pandas_udf(f"array<struct<{FIELDS}>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not state:
            state.append(GuessCost(shared.value))
        for texts in batches:
            yield texts.map(lambda text: [_row(f, min_cost) for f in findings_of(text, state[0], min_length)])

    text = F.col(text_col)
    found = docs.where(text.rlike(CONTEXT)).select(F.col(id_col).alias("__id"), F.explode(look(text)).alias("__found"))
    fields = [f.split()[0].strip("`") for f in FIELDS.split(", ")]
    return found.select(F.col("__id").alias(id_col), *[F.col(f"__found.{f}").alias(n) for f, n in zip(fields, named(id_col, tuple(fields)))])


FIELDS = "name string, start long, `end` long, log10_guesses double, n_parts long, kinds string, is_secret boolean"


def _row(finding: tuple, min_cost: float) -> dict:
    name, start, end, _, cost, parts = finding
    return {"name": name, "start": start, "end": end, "log10_guesses": cost, "n_parts": len(parts), "kinds": "+".join(dict.fromkeys(k for k, _, _ in parts)), "is_secret": cost >= min_cost}


def _masked(docs: DataFrame, text_col: str, min_cost: float, min_length: int, wordlist: str | None, mask: str) -> Column:
    """The text with every secret value replaced by ``mask``; null where there is none."""
    shared = docs.sparkSession.sparkContext.broadcast(load_words(wordlist))
    state: list[GuessCost] = []

    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not state:
            state.append(GuessCost(shared.value))

        def one(text: str | None) -> str | None:
            out, at = [], 0
            for _, a, b, _, cost, _ in findings_of(text or "", state[0], min_length):
                if cost >= min_cost:
                    out += [text[at:a], mask]
                    at = b
            return "".join([*out, text[at:]]) if out else None

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    text = F.col(text_col)
    return hide(F.when(text.rlike(CONTEXT), text))


def redacted(docs: DataFrame, text_col: str = "text", min_cost: float = MIN_COST, min_length: int = 4, wordlist: str | None = WORDLIST, mask: str = "[SECRET]") -> Column:
    """The text with every secret value replaced by ``mask``."""
    return F.coalesce(_masked(docs, text_col, min_cost, min_length, wordlist, mask), F.col(text_col))


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", min_cost: float = MIN_COST, min_length: int = 4, wordlist: str | None = WORDLIST
) -> DataFrame:
    """``docs`` with secrets masked, and the length column, if there is one, brought up to date where a mask was put."""
    masked = _masked(docs, text_col, min_cost, min_length, wordlist, mask)
    changed = {text_col: F.coalesce(masked, F.col(text_col))}
    if length_col in docs.columns:
        changed[length_col] = F.coalesce(F.length(masked).cast(docs.schema[length_col].dataType), F.col(length_col))
    return docs.withColumns(changed)
