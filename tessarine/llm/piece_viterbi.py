"""SentencePiece encoding and decoding by batched Viterbi.

Text is escaped as the model prescribes (a dummy prefix, spaces to U+2581) and cut before
each run of U+2581, a place that no piece spans. Every distinct word of a batch is
encoded once. Words of equal length advance together: for each end and each piece length,
the substring hashes of all those words are looked up in the sorted hashes of the
model's pieces, and the vectorised maximum keeps the best score and a backpointer. Of
words that are so long and so few that a step over them is no vector (texts without
spaces), the substrings of each length are looked up over all starts at once instead, and
one pass over the pieces found keeps the same scores and backpointers.

The segmentation is the one with the largest sum of piece scores. Of equal sums the one
whose last piece is longest wins. A character in no piece costs ``unknown`` (the least
score minus 10) and becomes byte pieces, or the unknown piece where the model has none.

Decoding joins the pieces' bytes, restores spaces and drops the dummy prefix; encoding
followed by decoding gives the text back exactly if the model has byte pieces.

Defined results
---------------
* null text: null; empty text: no ids, decodes to the empty text.
* decoding null: null; ids outside the vocabulary: ignored; control pieces: nothing.
* text that holds U+2581 itself decodes to a space there, as the format prescribes.
* repeated rows, ties: as above, the same ids each time. Empty tables: empty results.
* very long texts and words are encoded whole, in time proportional to their length.
* extra columns are ignored by :func:`encode`; a result column called like the id column
  gets an underscore.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mix64, named, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words, and the same where no piece holds a line feed, which then stands alone.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
WORD_OR_FEED = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
#: Encoded words that are kept per worker between slices; a matter of speed alone.
KEPT_WORDS = 100_000
#: Texts are encoded in slices of about so many characters, to bound a worker's memory.
SLICE_CHARS = 1_000_000


@dataclass
class Pieces:
    """keys: sorted hashes of the normal pieces, with ids and scores beside; texts: each piece's bytes."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    byte_ids: np.ndarray | None
    unknown_id: int
    texts: list[bytes]
    dummy_prefix: bool
    word: re.Pattern = WORD
    store: "Store" = None
    bytes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


class Store:
    """Encoded words: number by word; the ids of all words in one array, with starts and lengths beside."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.starts, self.sizes = np.empty(1 << 12, dtype=np.int64), np.empty(1 << 12, dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """words, their ids one after another, and how many each has."""
        first, total = len(self.number), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = ids
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(words)] = sizes
        self.used += total
        self.number.update(zip(words, range(first, first + len(words))))

    def shrink(self, words: int) -> None:
        """Beyond twice as many, forget all but the first ``words`` words, which are the common ones."""
        if len(self.number) > 2 * words:
            self.number = dict(itertools.islice(self.number.items(), words))
            self.used = int(self.starts[words])


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + size] of many spans."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def codes_of(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return raw.reshape(len(words), -1)


def rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial, from which the hash of any substring follows."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, codes.shape[1])[::1], axis=1, out=out[:, 1:])
    return out


def load(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model's pieces and scores; its segmenter is not used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts, normal, byte_ids = [], [], np.full(256, -1, dtype=np.int64)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i):
            texts.append(b"")
        elif sp.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            texts.append(piece.replace(SPACE, " ").encode())
            normal.append((piece, i, sp.get_score(i)))
    return build(normal, texts, byte_ids if (byte_ids >= 0).all() else None, sp.unk_id(), SPACE in sp.encode("x", out_type=str)[0])


def build(normal: list[tuple[str, int, float]], texts: list[bytes], byte_ids: np.ndarray | None, unknown_id: int, dummy_prefix: bool = True) -> Pieces:
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in normal):
        raise ValueError("a piece spans the start of a word")
    keys, ids, scores = np.empty(len(normal), np.uint64), np.array([i for _, i, _ in normal]), np.array([s for _, _, s in normal])
    for at, (piece, _, _) in enumerate(normal):
        keys[at] = substring_keys(rolling(codes_of([piece])), 0, len(piece))[0]
    order = np.argsort(keys)
    keys = keys[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces have one hash")
    return Pieces(keys, ids[order], scores[order], max(len(p) for p, _, _ in normal), float(scores.min()) - 10.0, byte_ids, unknown_id, texts, dummy_prefix, WORD if any("\n" in p for p, _, _ in normal) else WORD_OR_FEED)


_INV = pow(_BASE, -1, 1 << 64)


def substring_keys(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
    raw = (prefix[:, end] - prefix[:, start]) * powers(_INV, start + 1)[start]
    return mix64(raw + np.uint64(((end - start) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))


#: Words of at least a tenth of this are encoded one by one if there are fewer than LONG_WORD // length + 2 of their length.
LONG_WORD = 2000


def long_viterbi(pieces: Pieces, word: str) -> np.ndarray:
    """The best segmentation of one word: what :func:`viterbi` gives, by one pass over the pieces that occur in it."""
    prefix = rolling(codes_of([word]))[0]
    length, last = len(word), len(pieces.keys) - 1
    inverse = powers(_INV, length + 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in range(1, min(pieces.longest, length) + 1):
        raw = (prefix[size:] - prefix[:-size]) * inverse[: length - size + 1]
        keys = mix64(raw + np.uint64((size * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
        at = np.minimum(np.searchsorted(pieces.keys, keys), last)
        start = np.flatnonzero(pieces.keys[at] == keys)
        found.append((start + size, start, at[start]))
    ends, starts, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-starts, ends))  # as in viterbi: of equal sums the longest piece wins
    best, back, piece = [0.0] + [-np.inf] * length, [0] * (length + 1), [-1] * (length + 1)
    rows = zip(ends[order].tolist(), starts[order].tolist(), pieces.scores[at[order]].tolist(), pieces.ids[at[order]].tolist())
    end, start, score, key = next(rows, (length + 1, 0, 0.0, 0))
    unknown = pieces.unknown
    for here in range(1, length + 1):
        top, top_back, top_id = best[here - 1] + unknown, here - 1, -1
        while end == here:
            value = best[start] + score
            if value >= top:
                top, top_back, top_id = value, start, key
            end, start, score, key = next(rows, (length + 1, 0, 0.0, 0))
        best[here], back[here], piece[here] = top, top_back, top_id
    spots, here = np.full(length, -2, dtype=np.int32), length
    while here:
        spots[here - 1] = piece[here]
        here = back[here]
    return _with_bytes(pieces, spots, word).astype(np.int32) if (spots == -1).any() else spots[spots != -2]


def viterbi(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentations of words of one length: all ids one after another, and how many each word has."""
    if len(words[0]) >= LONG_WORD // 10 and len(words) < LONG_WORD // len(words[0]) + 2:
        each = [long_viterbi(pieces, w) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
    codes = codes_of(words)
    n, length = codes.shape
    prefix = rolling(codes)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((length + 1, n), dtype=np.int32)
    piece = np.zeros((length + 1, n), dtype=np.int32)
    last = len(pieces.keys) - 1
    for end in range(1, length + 1):
        top, top_back, top_id = best[end], back[end], piece[end]
        top[:], top_back[:], top_id[:] = best[end - 1] + pieces.unknown, end - 1, -1
        for start in range(end - 1, max(-1, end - 1 - pieces.longest), -1):
            keys = substring_keys(prefix, start, end)
            at = np.minimum(np.searchsorted(pieces.keys, keys), last)
            hits = np.flatnonzero(pieces.keys[at] == keys)
            if len(hits):
                at = at[hits]
                score = best[start, hits] + pieces.scores[at]
                better = score >= top[hits]
                hits, at = hits[better], at[better]
                top[hits], top_back[hits], top_id[hits] = score[better], start, pieces.ids[at]
    # backwards, all words together; ids fill a table from the right
    spots = np.full((n, length), -2, dtype=np.int32)
    at = np.full(n, length, dtype=np.int64)
    rows = np.arange(n)
    while len(rows):
        here = at[rows]
        spots[rows, here - 1] = piece[here, rows]
        at[rows] = back[here, rows]
        rows = rows[at[rows] > 0]
    unknown = np.flatnonzero((spots == -1).any(axis=1))
    if not len(unknown):
        return spots[spots != -2], (spots != -2).sum(axis=1)
    each = [row[row != -2] for row in spots]
    for row in unknown:
        each[row] = _with_bytes(pieces, spots[row], words[row])
    return np.concatenate(each).astype(np.int32), np.array([len(x) for x in each], dtype=np.int64)


def _with_bytes(pieces: Pieces, spots: np.ndarray, word: str) -> np.ndarray:
    out: list[int] = []
    for at, i in enumerate(spots):
        if i == -1:
            out += pieces.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))].tolist() if pieces.byte_ids is not None else [pieces.unknown_id]
        elif i != -2:
            out.append(int(i))
    return np.array(out, dtype=np.int64)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SLICE_CHARS characters each; a longer text is a slice of its own."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= SLICE_CHARS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode_slice(pieces: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and how many each text has."""
    pieces.store = pieces.store or Store()
    pieces.store.shrink(KEPT_WORDS)
    store, start = pieces.store, SPACE if pieces.dummy_prefix else ""
    words: list[str] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    for at, text in enumerate(texts):
        if text:
            words += pieces.word.findall(start + text.replace(" ", SPACE))
        counts[at + 1] = len(words)
    by_length: dict[int, list[str]] = {}
    for w in set(words).difference(store.number):
        by_length.setdefault(len(w), []).append(w)
    for length, new in by_length.items():
        new.sort()
        step = max(1, 500_000 // (length + 1))
        for at in range(0, len(new), step):
            store.add(new[at : at + step], *viterbi(pieces, new[at : at + step]))
    numbers = np.fromiter(map(store.number.__getitem__, words), dtype=np.int64, count=len(words))
    sizes = store.sizes[numbers]
    ends = np.concatenate([[0], np.cumsum(sizes)])[counts]
    return gather(store.flat, store.starts[numbers], sizes), np.diff(ends)


def encode_texts(pieces: Pieces, texts: list[str | None]) -> list[np.ndarray | None]:
    """Ids of each text."""
    out: list[np.ndarray | None] = []
    for a, b in slices(texts):
        flat, sizes = _encode_slice(pieces, texts[a:b])
        out += [None if t is None else ids for t, ids in zip(texts[a:b], np.split(flat, np.cumsum(sizes)[:-1]))]
    return out


def _spelled(pieces: Pieces, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ids one after another, and how many each id has; ids outside the vocabulary have none."""
    if pieces.bytes is None:
        sizes = np.array([len(t) for t in pieces.texts] + [0], dtype=np.int64)
        pieces.bytes = np.frombuffer(b"".join(pieces.texts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
    data, starts, sizes = pieces.bytes
    at = np.where((flat >= 0) & (flat < len(pieces.texts)), flat, len(pieces.texts))
    return gather(data, starts[at], sizes[at]), sizes[at]


def decode_many(pieces: Pieces, ids: list[np.ndarray | None]) -> list[str | None]:
    """The texts of many id lists, whose bytes are looked up together."""
    known = [np.asarray(i, dtype=np.int64) if i is not None else np.empty(0, np.int64) for i in ids]
    if not known:
        return []
    data, sizes = _spelled(pieces, np.concatenate(known))
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, known)])]
    raw, cut, out = data.tobytes(), pieces.dummy_prefix, []
    for i, a, b in zip(ids, ends[:-1].tolist(), ends[1:].tolist()):
        text = None if i is None else raw[a:b].decode("utf-8", "replace")
        out.append(text[1:] if cut and text and text[0] == " " else text)
    return out


def decode_ids(pieces: Pieces, ids: np.ndarray | None) -> str | None:
    return decode_many(pieces, [ids])[0]


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> Column:
    """The ids of the text as array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.tolist()
            for a, b in slices(texts):
                yield pd.Series(encode_texts(shared.value, texts[a:b]), dtype=object)

    return run(F.col(text_col))


def decoded(docs: DataFrame, ids_col: str = "ids", model: str = MODEL) -> Column:
    """The text of an array of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(decode_many(shared.value, ids.tolist()), dtype=object)

    return run(F.col(ids_col))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids, n_tokens, round_trip: whether decoding gives the text back). Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("ids array<int>, n_tokens int, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = shared.value
        for texts in batches:
            texts = texts.tolist()
            for a, b in slices(texts):  # each slice is an output batch of its own
                ids = encode_texts(pieces, texts[a:b])
                same = [None if t is None else back == t.replace(SPACE, " ") for t, back in zip(texts[a:b], decode_many(pieces, ids))]
                counts = pd.Series([None if i is None else len(i) for i in ids], dtype="Int32")
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "n_tokens": counts, "round_trip": pd.Series(same, dtype=object)})

    fields = ("ids", "n_tokens", "round_trip")
    coded = docs.select(F.col(id_col).alias("__id"), run(F.col(text_col)).alias("__e"))
    return coded.select(F.col("__id").alias(id_col), *[F.col(f"__e.{f}").alias(n) for f, n in zip(fields, named(id_col, fields))])
