"""Blocks of documents, and the exchange that brings every distinct word of a block to its owner and back.

Exploding each word of a corpus into a row moves the corpus several times over. Here a row stands for all words that one
block of documents sends to one owner: each distinct word once, compressed. The owner of a word (a hash range) sees it once
for each block that uses it, whatever its frequency, answers for it once, and the answers return to the block, where the
words' positions put them together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, give_back, partitions, text_of

#: Blocks in a partition, at least where the session has partitions for more.
BLOCKS = 16
#: Bytes of a block's texts that are cut into units at a time, and positions of units whose answers are laid out at a time.
RUN, POSITIONS = 1 << 20, 1 << 18
_REQUESTS = "part int, block int, words binary"
_ANSWERS = "block int, part int, answer binary"


def layout(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of an array of large binaries."""
    _, offsets, data = strings.buffers()
    found = np.frombuffer(offsets, np.int64, len(strings) + 1, 8 * strings.offset) if offsets is not None and len(strings) else np.zeros(1, np.int64)
    return found, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def strings_of(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def pack_strings(strings: pa.Array) -> bytes:
    offsets, data = layout(strings)
    return pack_arrays(np.diff(offsets).astype(np.uint32), data[offsets[0] : offsets[-1]])


def unpack_strings(value: bytes) -> pa.Array:
    lengths, data = unpack_arrays(value)
    return strings_of(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), data)


def pack_arrays(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Compressed little-endian arrays of any integer or float kind."""
    head = ";".join(f"{a.dtype.str}:{a.size}" for a in arrays).encode()
    raw = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).view(np.uint8).data if a.size else b"" for a in arrays)])
    return bytes(memoryview(zstandard.ZstdCompressor(level=level).compress(raw)))  # what compress() returns keeps the memory of the longest result


def unpack_arrays(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, size in (x.split(":") for x in raw[4 : 4 + n].decode().split(";")):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += out[-1].nbytes
    return out


def _pack(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, block = batch.column(0), batch.column(2).to_numpy()
        raw, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_binary())  # the bytes stay where they are; a block's own are copied when it is packed
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        keys, values = [], []
        for rows in np.split(order, cuts):
            offsets, data = layout(texts.take(pa.array(rows)))
            keys.append(block[rows[0]])
            values.append(pack_arrays(raw[rows], known[rows].astype(np.uint8), np.diff(offsets), data[offsets[0] : offsets[-1]], level=level))
        packed = pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["block", "payload"])
        del batch, ids, texts, values
        yield packed
        del packed
        give_back()


def blocks_of(docs: DataFrame, text: str = "text", block_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """block, payload: the whole texts of docs, dealt to blocks by a hash of doc_id and text and partitioned by block.

    Null texts count as empty. Rows of one id, or of none, are dealt apart by their texts. Repeated rows stay repeated.
    """
    n = block_count(docs, text, block_bytes)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    return rows.mapInArrow(lambda it: _pack(it, level), "block int, payload binary").repartition(max(partitions(docs.sparkSession), -(-n // BLOCKS)), "block")


def released(table: pa.Table) -> pa.Table:
    """The table of a group that is done, after what it took has been given back: idle workers keep their memory otherwise."""
    give_back()
    return table


def text_hash(text: bytes) -> int:
    """Spark's xxhash64 of a text, unsigned."""
    return xxhash.xxh64_intdigest(text, 42)


def documents_in(payloads: pa.ChunkedArray) -> tuple[list[int | None], list[bytes]]:
    """The ids and texts of a block by id (none last), then the texts' hash: an order that holds across blocks too."""
    rows: list[tuple[bool, int, int, bytes]] = []
    for payload in payloads:
        ids, known, lengths, text = unpack_arrays(payload.as_py())
        text, ends = text.tobytes(), np.cumsum(lengths).tolist()
        texts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        rows += zip((known == 0).tolist(), ids.tolist(), map(text_hash, texts), texts, strict=True)
    rows.sort()
    return [None if null else i for null, i, _, _ in rows], [t for *_, t in rows]


#: Cuts texts into units: all units end to end, and how many each text has.
Units = Callable[[list[bytes]], tuple[pa.Array, np.ndarray]]


def as_strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


def flattened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lists' strings that are not empty, as bytes end to end, and how many each list has."""
    flat = lists.flatten().view(pa.large_binary())
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(before[ends])


def blank_separated(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Units: what stands between runs of the six ASCII blanks."""
    return flattened(pc.ascii_split_whitespace(as_strings(texts)))


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _eights(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every string's bytes, eight at a time (the last ones filled with zeros), end to end, and where each string begins."""
    lengths = np.diff(offsets)
    n = np.maximum(1, (lengths + 7) >> 3)
    first = np.cumsum(n) - n
    total = int(n.sum())
    k = np.arange(total) - np.repeat(first, n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    found = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[np.repeat(offsets[:-1], n) + 8 * k]
    short = (8 * (8 - np.clip(np.repeat(lengths, n) - 8 * k, 0, 8))).astype(np.uint64)
    kept = np.where(short < 64, (found << (short & np.uint64(63))) >> (short & np.uint64(63)), np.uint64(0))
    return kept, first


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    offsets, data = layout(strings)
    if not len(strings):
        return np.zeros(0, np.uint64)
    x, first = _eights(offsets, data)
    x = x + _STEP * (np.arange(1, len(x) + 1, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(x)))).astype(np.uint64))
    for m in _MIX:
        x ^= x >> np.uint64(33)
        x *= m
    x ^= x >> np.uint64(29)
    out = np.add.reduceat(x, first) + np.diff(offsets).astype(np.uint64) * _STEP
    return out ^ (out >> np.uint64(31))


def numbered(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in order of appearance, and each string's number among them. Hashes group, bytes decide."""
    if not len(strings):
        return strings, np.zeros(0, np.int64)
    codes, _ = pd.factorize(hashes(strings))
    first = np.empty(int(codes.max()) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    offsets, data = layout(strings)
    lengths = np.diff(offsets)
    alike = (lengths == lengths[first][codes]).all()
    if alike:
        x, start = _eights(offsets, data)
        n = np.maximum(1, (lengths + 7) >> 3)
        alike = (x == x[np.repeat(start[first][codes] - start, n) + np.arange(len(x))]).all()
    if not alike:  # two strings share a hash
        found = strings.dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return strings.take(pa.array(first)), codes


def runs(texts: list[bytes], run_bytes: int = RUN) -> Iterator[list[bytes]]:
    """The texts in turn, about run_bytes of them at a time; a longer text comes alone. One empty run where there are none."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > run_bytes:
            yield texts[start:k]
            start, size = k, 0
        size += len(t)
    yield texts[start:]


def coded(texts: list[bytes], units: Units, run_bytes: int = RUN) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units in order of appearance, each position's number among them, and how many each text has.

    Texts are cut in runs, so that positions and bytes of all units are held for one run at a time.
    """
    found, codes, sizes = [], [], []
    for run in runs(texts, run_bytes):
        flat, n = units(run)
        words, own = numbered(flat)
        found.append(words)
        codes.append(own.astype(np.int32) if len(words) < 1 << 31 else own)
        sizes.append(n)
    if len(found) == 1:
        return found[0], codes[0], sizes[0]
    words, place = numbered(pa.concat_arrays(found))
    place = place.astype(np.int32) if len(words) < 1 << 31 else place
    ends = np.cumsum([len(f) for f in found]).tolist()
    for k, end in enumerate(ends):
        codes[k] = place[end - len(found[k]) : end][codes[k]]
    return words, np.concatenate(codes), np.concatenate(sizes)


def part_count(docs: DataFrame, text: str = "text", part_bytes: int = 128 << 20) -> int:
    """Owners of words: two for each shuffle partition, more for a corpus of over part_bytes for each of them."""
    return block_count(docs, text, part_bytes, 2 * partitions(docs.sparkSession))


def owners(words: pa.Array, parts: int) -> np.ndarray:
    return (hashes(words) % np.uint64(parts)).astype(np.int32)


def by_owner(words: pa.Array, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The words' order by owner, and each owner's (part, first, end) in it."""
    part = owners(words, parts)
    order = np.argsort(part, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
    return order, [(int(part[order[a]]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def exchange(blocks: DataFrame, parts: int, units: Units, answer: Callable, finish: Callable, schema: str, known: DataFrame | None = None) -> DataFrame:
    """finish(block, doc_ids, texts, words, codes, sizes, place, arrays) for every block, as rows of `schema` (a pyarrow table).

    answer(words) is called in the words' owner with each distinct word once; it returns a function from an array of their
    numbers to the arrays that go back. codes: each position's word; sizes: each text's positions; place: each word's place
    in the joined answers; known: rows that owners keep, by `part` (see owners and part_count); answer(words, rows) then
    gets those of its own part. arrays: the answers of each owner, in the order that place counts in.
    """

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, texts = documents_in(table.column("payload"))
        words, _, _ = coded(texts, units)
        order, groups = by_owner(words, parts)
        words = words.take(pa.array(order))
        return pa.table({"part": pa.array([p for p, _, _ in groups], pa.int32()), "block": pa.array([block] * len(groups), pa.int32()), "words": pa.array([pack_strings(words[a:b]) for _, a, b in groups], pa.binary())})

    def own(table: pa.Table, *rows: pa.Table) -> pa.Table:
        asked = [unpack_strings(x.as_py()) for x in table.column("words")]
        words, codes = numbered(pa.concat_arrays(asked) if asked else pa.array([], pa.large_binary()))
        reply = answer(words, *rows)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": pa.array([pack_arrays(*reply(a)) for a in (np.split(codes, cuts) if asked else [])], pa.binary())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = documents_in(left.column("payload"))
        words, codes, sizes = coded(texts, units)
        order, _ = by_owner(words, parts)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        replies = sorted(zip(right.column("part").to_pylist(), right.column("answer").to_pylist(), strict=True))
        arrays = [unpack_arrays(a) for _, a in replies]
        return finish(left.column("block")[0].as_py(), ids, texts, words, codes, sizes, place, arrays)

    asked = blocks.groupBy("block").applyInArrow(lambda t: released(ask(t)), _REQUESTS)
    asked = asked.groupBy("part")
    answered = asked.applyInArrow(lambda t: released(own(t)), _ANSWERS) if known is None else asked.cogroup(known.groupBy("part")).applyInArrow(lambda t, rows: released(own(t, rows)), _ANSWERS)
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda a, b: released(join(a, b)), schema)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, for each pair, end to end."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def spread(codes: np.ndarray, place: np.ndarray, arrays: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lays out answers of the form (lengths, values): each position's length, and all positions' values end to end."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    lengths = np.concatenate([a[0] for a in arrays]).astype(np.int64)
    values = np.concatenate([a[1] for a in arrays])
    starts = np.cumsum(lengths) - lengths
    n = np.empty(len(codes), np.int32 if int(lengths.max()) < 1 << 31 else np.int64)
    for k in range(0, len(codes), POSITIONS):
        n[k : k + POSITIONS] = lengths[place[codes[k : k + POSITIONS]]]
    out, end = np.empty(int(n.sum(dtype=np.int64)), values.dtype), 0
    for k in range(0, len(codes), POSITIONS):
        own = values[ranges(starts[place[codes[k : k + POSITIONS]]], n[k : k + POSITIONS].astype(np.int64))]
        out[end : end + len(own)] = own
        end += len(own)
    return n, out


def id_answers(encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """An answer() of token ids: for each asked word its number of ids, then all ids. encode: words to just that."""

    def answer(words: pa.Array) -> Callable:
        lengths, flat = encode(words)
        starts = np.cumsum(lengths) - lengths

        def reply(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = lengths[asked]
            ends = np.cumsum(n)
            return n.astype(np.uint32), flat[np.repeat(starts[asked] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

        return reply

    return answer


def laid_out(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The length of each list, and all values end to end."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return lengths, np.fromiter((i for own in ids for i in own), np.uint32, int(lengths.sum()))
