"""Packing token pieces into windows by non-negative least squares over the histogram of their lengths.

Documents are cut at multiples of the window, so only each document's last piece is shorter. Shallow combinations of
lengths that fill a window are the columns of a least-squares problem whose right side is the histogram; its rounded
solution says how often each combination is used, and what remains is packed greedily, combination by combination.
Everything on the driver is bounded by the window, not by the input: at most 2,048 counts and a list of combinations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialise

WINDOW = 2048
#: A special token's string, put between words; words that hold such a string are encoded one by one.
BETWEEN = "<|startoftext|>"
#: Combinations of three lengths take two of them from this many of the commonest lengths.
COMMON = 96
_PIECES = "block int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rank bigint"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text", window: int = WINDOW) -> DataFrame:
    """block, doc_id, start, length, ids_crc32, doc_tokens, rank: every document's ids in pieces of one window or less.

    rank numbers a block's pieces of one length. A null or empty text has the end id alone. A special token's string in
    a text becomes that token's one id, the library's default.
    """

    def encode_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        t = _tokenizer(tokenizer_path)
        between = t.token_to_id(BETWEEN)
        plain = words.to_pylist()
        odd = np.array([between is None or b"<|" in w for w in plain], bool)
        lengths, found = np.zeros(len(plain), np.int64), []
        own = np.flatnonzero(~odd)
        for k in range(0, len(own), 2000):  # many words in one string, parted by a special token, which no match crosses
            some = own[k : k + 2000]
            ids = np.array(t.encode(BETWEEN.join([plain[i].decode("utf-8", "replace") for i in some.tolist()]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == between)
            lengths[some] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            found.append(np.delete(ids, cuts))
        other = np.flatnonzero(odd)
        n, ids = B.laid_out([t.encode(plain[i].decode("utf-8", "replace"), add_special_tokens=False).ids for i in other.tolist()])
        lengths[other] = n
        if not len(other):
            return lengths, np.concatenate(found) if found else ids
        flat, mine = np.zeros(int(lengths.sum()), np.uint32), np.repeat(odd, lengths)
        flat[mine], flat[~mine] = ids, np.concatenate([*found, np.zeros(0, np.uint32)])
        return lengths, flat

    def finish(block, ids, texts, words, codes, sizes, place, arrays) -> pa.Table:
        n, values = B.spread(codes, place, arrays)
        at = [0, *np.cumsum(sizes).tolist()]
        ends = np.cumsum([0, *(int(n[a:b].sum(dtype=np.int64)) for a, b in zip(at, at[1:], strict=False))]).tolist()
        last = np.array([end_id], "<u4").tobytes()
        raw = memoryview(np.ascontiguousarray(values, "<u4").view(np.uint8))
        rows, ranks = [], {}
        for doc_id, a, b in zip(ids, ends, ends[1:], strict=False):
            total = b - a + 1
            for start in range(0, total, window):
                length = min(window, total - start)
                crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + start + length, b)])
                if start + length == total:
                    crc = zlib.crc32(last, crc)
                rank = ranks[length] = ranks.get(length, -1) + 1
                rows.append((doc_id, start, length, crc, total, rank))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
        return pa.table({"block": pa.array([block] * len(rows), pa.int32())} | {k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)})

    return B.exchange(B.blocks_of(docs, text, 10 << 20), B.part_count(docs, text), B.blank_separated, B.id_answers(encode_words), finish, _PIECES)


def combinations(counts: np.ndarray, window: int, common: int = COMMON) -> list[tuple[int, ...]]:
    """Shallow combinations of one, two or three occurring lengths that fill the window exactly."""
    has = counts > 0
    out = [(window,)] if has[window] else []
    out += [(a, window - a) for a in range(1, window // 2 + 1) if has[a] and has[window - a]]
    top = sorted(int(x) for x in np.argsort(-counts[:window], kind="stable")[:common] if counts[x])
    out += sorted({tuple(sorted((a, b, window - a - b))) for i, a in enumerate(top) for b in top[i:] if a + b < window and has[window - a - b]})
    return out


def solve(columns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2 by accelerated projected gradient; A has a column for each combination."""
    if not columns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row = np.array([a for c in columns for a in c])
    times = lambda x: np.bincount(row, x[col], len(counts))
    back = lambda r: np.bincount(col, r[row], len(columns))
    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 0.95 / np.linalg.norm(back(times(v)))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - counts))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, times), ...), repeats): combinations that use up counts[length] exactly, each within the window."""
    left = counts.astype(np.int64).copy()
    columns = combinations(left, window)
    x = np.floor(solve(columns, counts.astype(float)) + 0.5).astype(np.int64)
    out = []

    def use(combination: tuple[tuple[int, int], ...], most: int) -> None:
        n = min(most, *(int(left[a]) // k for a, k in combination))
        if n > 0:
            for a, k in combination:
                left[a] -= n * k
            out.append((combination, n))

    for k in np.argsort(-x, kind="stable"):
        if x[k] > 0:
            use(tuple((a, columns[k].count(a)) for a in sorted(set(columns[k]), reverse=True)), int(x[k]))
    while left.any():
        lengths = np.flatnonzero(left)[::-1]
        room, combination = window, []
        for a in lengths.tolist():
            k = min(room // a, int(left[a]))
            if k:
                combination.append((a, k))
                room -= a * k
            if not room:
                break
        use(tuple(combination), 1 << 62)
    return out


def places(combos: list, window: int) -> dict[str, np.ndarray]:
    """For each slot of a combination: length, first rank, rank after the last, first sequence, offset, times; sorted by length and rank."""
    used = [0] * (window + 1)
    rows, sequence = [], 0
    for combination, n in combos:
        offset = 0
        for a, k in combination:
            rows.append((a, used[a], used[a] + n * k, sequence, offset, k))
            used[a] += n * k
            offset += a * k
        sequence += n
    rows.sort()
    names = ("length", "low", "high", "sequence", "offset", "times")
    return {k: np.array(c, np.int64) for k, c in zip(names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)}


def _placed(slots: dict[str, np.ndarray]):
    base = int(slots["high"].max()) + 1 if len(slots["high"]) else 1
    keys = slots["length"] * base + slots["low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * base + rank, side="right") - 1
            at = rank - slots["low"][k]
            sequence = slots["sequence"][k] + at // slots["times"][k]
            offset = slots["offset"][k] + at % slots["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of docs.

    Sequences are numbered from 0 without gaps and filled from offset 0. A null text counts as empty and is packed as
    its end id. Repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
    A text may have any length that a Spark string has; it is cut into whole windows and a rest. Of pieces of one length
    those of the lower block, then of the earlier row in it, get the earlier places; blocks follow from doc_id and text.
    """
    found = materialise(pieces(docs, tokenizer_path, end_id, text, window))
    own = found.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    own = materialise(own.select("block", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    counts = np.zeros(window + 1, np.int64)
    for length, n in own.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        counts[length] = n
    slots = places(plan(counts, window), window)
    ranked = found.join(own.select("block", "length", "before"), ["block", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranked.mapInArrow(_placed(slots), ", ".join(f"{c} bigint" for c in out))
