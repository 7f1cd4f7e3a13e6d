"""Byte-level BPE: encoding through one global exchange of distinct words, decoding through the token-byte table."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks as B

#: Whitespace runs, or blanks other than a space and a newline, or a NUL: such texts are cut by the pattern itself.
_ODD = re.compile(r"\s\s|[^\S \n]|\x00")


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def words_for(pattern: str) -> B.Units:
    """Cuts texts into words that the pattern matches independently of each other.

    In a text whose white space is single spaces and newlines no match runs across one, so the cut is before each of
    them: a word stands for itself with the space before it, a newline is kept in front, and the first word, which has
    neither, gets a NUL in front. In any other text the words are the pattern's own matches, each with a NUL in front.
    """

    def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        odd = np.array([bool(_ODD.search(s)) for s in decoded], bool)
        plain = [b"" if o else b"\x00" + t.replace(b"\n", b" \n") for t, o in zip(texts, odd, strict=True)]
        lists = pc.split_pattern(B.as_strings(plain), pattern=" ")
        flat, sizes = lists.flatten().view(pa.large_binary()), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not odd.any():
            return flat, sizes
        matches = [[b"\x00" + m.encode() for m in _pattern(pattern).findall(s)] for s, o in zip(decoded, odd, strict=True) if o]
        starts = np.cumsum(sizes) - sizes
        own = np.array([len(m) for m in matches], np.int64)
        starts[odd], sizes[odd] = len(flat) + np.cumsum(own) - own, own
        flat = pa.concat_arrays([flat, pa.array([m for ms in matches for m in ms], pa.large_binary())])
        ends = np.cumsum(sizes)
        return flat.take(pa.array(np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1]))), sizes

    return words


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", block_bytes: int = 5 << 20) -> DataFrame:
    """doc_id, n_tokens, ids: token ids as little-endian unsigned 32-bit integers, one row for each row of docs.

    Null texts count as empty and have no ids. Repeated rows give repeated results, other columns are ignored, and an
    empty table gives an empty result. Every distinct word of the corpus is encoded once, by its owner. A text may have any
    length that a Spark string has, and a word any length that its text has; both are encoded whole.
    """

    def encode_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        one = _encoding(ranks_path, pattern).encode_ordinary
        return B.laid_out([one((w[1:] if w[:1] == b"\x00" else w if w[:1] == b"\n" else b" " + w).decode("utf-8", "replace")) for w in words.to_pylist()])

    def finish(block, ids, texts, words, codes, sizes, place, arrays) -> pa.Table:
        n, values = B.spread(codes, place, arrays)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        raw = values.astype("<u4").tobytes()
        cut = (4 * ends).tolist()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(np.diff(ends)), "ids": pa.array([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    return B.exchange(B.blocks_of(docs, text, block_bytes, level=6), B.part_count(docs, text), words_for(pattern), B.id_answers(encode_words), finish, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with a column `decoded`: the bytes of its ids, by the token-byte table (bounded: one row for each token).

    Null ids count as none. An id outside the table raises IndexError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _ranks(ranks_path)
        tokens = [b""] * (max(of.values()) + 1)
        for token, rank in of.items():
            tokens[rank] = token
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
        for batch in batches:
            out = []
            for value in batch.column("ids"):
                ids = np.frombuffer(value.as_py() or b"", "<u4")
                n = lengths[ids]
                ends = np.cumsum(n)
                out.append(flat[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])
            del out
            pa.default_memory_pool().release_unused()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
