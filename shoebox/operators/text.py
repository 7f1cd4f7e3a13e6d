"""Text for encoders: unigram and hash tokenisation, greedy decoding of recognised text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARSET = "0123456789abcdefghijklmnopqrstuvwxyz"
LONGEST, FALLBACK = 32, math.log(1e-10)
#: Texts whose pieces a task holds at a time; words whose ids a task keeps.
ROWS, KNOWN = 256, 1 << 18
# Fixed values of the text encoder's vocabulary.
START_ID, END_ID, WORD_IDS = 49406, 49407, 49405
_BITS = (1 << 64) - 1


def ctc_decode(steps: Column) -> Column:
    """The text of an array of score arrays: best of the first 37 classes, repeats once, class 0 is blank."""
    best = F.transform(steps, lambda s: F.array_position(F.slice(s, 1, 37), F.array_max(F.slice(s, 1, 37))).cast("int") - 1)
    chars = F.transform(best, lambda c, i: F.when((c > 0) & ((i == 0) | (c != F.get(best, i - 1))), F.substring(F.lit(CHARSET), c, F.lit(1))))
    return F.array_join(F.filter(chars, lambda x: x.isNotNull()), "")


def segment(text: str, scores: dict[str, float], sizes: dict[str, list[int]] | None = None) -> list[str]:
    """Best-scoring cut of the text, with word marks for spaces, into vocabulary pieces; a lone character costs FALLBACK.

    Of equal cuts the one with the longer last piece is taken. sizes: sizes_of(scores), if known.
    """
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    sizes = sizes_of(scores) if sizes is None else sizes
    best, via, score_of, sizes_at = [0.0], [0], scores.get, sizes.get
    for end, last in enumerate(text, 1):
        top, size = None, 1
        for z in sizes_at(last, ()):
            own = score_of(text[end - z : end]) if z <= end else None
            if own is not None and (top is None or best[end - z] + own > top):
                top, size = best[end - z] + own, z
        best.append(best[end - 1] + FALLBACK if top is None else top)
        via.append(size)
    out, end = [], len(text)
    while end:
        out.append(text[end - via[end] : end])
        end -= via[end]
    return out[::-1]


def sizes_of(scores: dict[str, float]) -> dict[str, list[int]]:
    """For each character the lengths of the pieces that end with it, longest first."""
    found: dict[str, set[int]] = {}
    for w in scores:
        if 0 < len(w) <= LONGEST:
            found.setdefault(w[-1], set()).add(len(w))
    return {c: sorted(n, reverse=True) for c, n in found.items()}


def _words(text: str | None) -> list[str]:
    """The words of a text in lower case; an empty text has none, and between two spaces stands an empty word."""
    return text.lower().split(" ") if text else []


def _numbers(words: list[str], known: dict, number: Callable[[str], object], most: int = KNOWN) -> list:
    """number() of each word, kept in known for the next texts of the task: at most `most` words (and those of one text) at a time."""
    try:
        return [known[w] for w in words]
    except KeyError:
        if len(known) > most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = number(w)
        return [known[w] for w in words]


def unigram_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], length: int, text: str = "text", end_id: int = 1, unknown_id: int = 2, out: str = "tokens", windows: bool = False, known: int = KNOWN) -> DataFrame:
    """df with fixed-length ids: pieces in order, the end id, then 0. The vocabulary (a model's fixed list) goes to every task.

    The encoder's form ends with the pieces that fit. With windows, a text has as many rows as it fills, numbered by `window`
    from 0, so that every piece comes out; an empty text has one.

    Where no piece runs across words, a task cuts a word when it first meets it and keeps its ids, of up to about `known`
    words at a time, for the texts that follow: nothing is shuffled or goes through the driver.
    """
    ids = {w: k for k, (w, _) in enumerate(vocabulary)}
    scores = dict(vocabulary)
    sizes = sizes_of(scores)
    own: dict[str, list[int]] = {}

    def numbers(pieces: list[str]) -> list[int]:
        return [ids.get(p, unknown_id) for p in pieces]

    def word(w: str) -> list[int]:
        return numbers(segment(w, scores, sizes) if w else ["▁"])

    if any("▁" in w[1:] for w in scores):
        return _windows(df, lambda t: np.array(numbers(segment((t or "").lower(), scores, sizes)), np.int32), length, text, end_id, out, windows)
    return _windows(df, lambda t: np.fromiter(chain.from_iterable(_numbers(_words(t), own, word, known)), np.int32), length, text, end_id, out, windows)


def _windows(df: DataFrame, numbers: Callable[[str | None], np.ndarray], length: int, text: str, end_id: int, out: str, windows: bool) -> DataFrame:
    """df with the ids of each text in windows of a fixed length."""
    fits = length - 1
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = [numbers(t) for t in part.column(at).to_pylist()]
                n = np.array([max(1, -(-len(x) // fits)) if windows else 1 for x in found])
                ends = np.cumsum(n)
                ids = np.zeros((int(ends[-1]), length), np.int32)
                for x, stop, rows in zip(found, ends.tolist(), n.tolist(), strict=True):
                    own = ids[stop - rows : stop]
                    full = min(len(x) // fits, rows)
                    own[:full, :fits] = x[: full * fits].reshape(full, fits)
                    own[:full, fits] = end_id
                    if full < rows:
                        rest = x[full * fits :]
                        own[full, : len(rest)] = rest
                        own[full, len(rest)] = end_id
                row = np.repeat(np.arange(part.num_rows), n)
                columns = [c.take(pa.array(row)) for c in part.columns]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, length, dtype=np.int32)), pa.array(ids.ravel())))
                names = [*part.schema.names, out]
                if windows:
                    columns.append(pa.array(np.arange(len(row)) - np.repeat(ends - n, n)))
                    names.append("window")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` array<int>" + (", window long" if windows else ""))


def word_id(word: str) -> int:
    """31-polynomial of the characters in 64-bit arithmetic, made positive at each step, within 1..WORD_IDS."""
    h = 0
    for c in word:
        h = (h * 31 + ord(c)) & _BITS
        if h >> 63:
            h = -h & _BITS  # the least number stays as it is
    return (h % WORD_IDS if not h >> 63 else -(h % WORD_IDS)) + 1


def hash_tokens(texts: Column, length: int) -> Column:
    """Fixed-length ids of a text column: start, one id for each word, end, then 0."""
    known: dict[str, int] = {}

    @F.arrow_udf("array<int>")
    def tokens(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), length), np.int32)
        out[:, 0] = START_ID
        for k, text in enumerate(column.to_pylist()):
            words = (text or "").lower().split()[: length - 2]
            out[k, 1 : 1 + len(words)] = _numbers(words, known, word_id)
            out[k, 1 + len(words)] = END_ID
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, length, dtype=np.int32)), pa.array(out.ravel()))

    return tokens(texts)


def word_windows(texts: Column, words: int) -> Column:
    """The words of a text, so many at a time and joined by spaces, in order; one empty window for a text without words."""
    every = F.filter(F.split(F.coalesce(texts, F.lit("")), r"[\x20\x09-\x0D\x1C-\x1F\x85\xA0]+"), lambda w: w != "")

    def cut(own: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.size(own) / F.lit(words)).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(own, k * words + 1, words), " "))

    # As a lambda's argument the words are found once for a text; named in the lambda of a window, once for each window.
    return F.flatten(F.transform(F.array(every), cut))
