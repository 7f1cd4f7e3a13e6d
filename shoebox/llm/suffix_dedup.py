"""Repeated byte strings across and inside documents, by sorted suffixes in range-partitioned buckets.

Every string of SPAN = 100 bytes has an anchor: the position of its GRAM = 32 bytes with the least hash. Equal strings
have equal grams at the same distance from their starts, so only suffixes that start at anchors (about one byte in 35)
need comparing, together with the strings that each of them stands for. Four steps, all on blocks of documents:

1. Owners of gram hashes say which grams occur in more than one place; the other anchors stand for unique strings.
2. Each block sends its remaining anchors, each different context once, to buckets: ranges of suffixes between splitters
   that were sampled from the documents. Anchors of a gram with very many contexts would fill one bucket; their strings are
   sent as suffixes of their own, which splitters of up to SPAN bytes part.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time, and finds equal ones as neighbours; the strings
   around equal grams are compared the same way. All but the first occurrence of a string are marked. Suffixes that are
   equal over the bytes that are compared lie on one side of every splitter, so no equal strings face each other across a
   boundary.
4. The marks return to the blocks, which cut the bytes that marked strings cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import ranges
from .common import text_of

SPAN, GRAM = 100, 32
#: Strings around a gram with more contexts than this are suffixes of their own.
HOT = 4096
#: Bytes of documents for each bucket, and for each owner of gram hashes.
BUCKET_BYTES = 64 << 20
#: Documents that splitters are sampled from, and leading bytes taken from each.
SAMPLE_DOCS, SAMPLE_EACH = 2000, 8
#: Bytes of documents that are hashed at a time.
RUN = 1 << 19
#: Strings that a bucket compares at a time; so few rows multikey quicksort leaves to a plain sort.
BATCH, SMALL = 400_000, 1 << 14
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_at(buffer: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from every position on, as numbers."""
    return np.ndarray((max(0, len(buffer) - 7),), kind, buffer, 0, (1,))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    if len(text) < GRAM:
        return np.zeros(0, np.uint64)
    w = words_at(text, "<u8").astype(np.uint64)
    n = len(text) - GRAM + 1
    h = w[:n] * _ODD[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += w[8 * k : 8 * k + n]
        h *= _ODD[k]
    h ^= h >> np.uint64(32)
    return h


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that lie end to end: each anchor's position and gram hash, and the first and last string it stands for.

    No string crosses documents, so whole documents are taken RUN bytes at a time, which keeps the arrays small.
    """
    found, start = [], 0
    while start < len(text):
        last = min(int(np.searchsorted(ends, start + RUN)), len(ends) - 1)
        stop = int(ends[last])
        own = ends[np.searchsorted(ends, start, side="right") : last + 1] - start
        at, h, a, b = _anchors(text[start:stop], own)
        found.append((at + start, h, a + start, b + start))
        start = stop
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none.astype(np.uint64), none, none), *found, strict=True))


def _anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    h = gram_hashes(text)
    width = SPAN - GRAM + 1
    if len(h) < width:
        return none, np.zeros(0, np.uint64), none, none
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    n = len(least)
    valid = np.ones(n, bool)
    for end in ends.tolist():
        valid[max(0, end - SPAN + 1) : end] = False
    starts = np.flatnonzero(valid)
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return at[new], h[at[new]], starts[new], starts[last]


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings by group, then by their bytes, eight at a time; those of one group are equally long, 8 bytes or more.

    words: the eight bytes (big-endian) from each position of a buffer. Each step parts the rows at a pivot of the present
    eight bytes into less, equal and greater; only equal ones go on to the next eight. Returns the rows of strings that
    equal a neighbour, in sorted order, and the number of their group of equals.
    """
    last = 1 + -(-int(lengths.max()) // 8) if len(lengths) else 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(starts)), 0)]

    def key(rows: np.ndarray, depth: int) -> np.ndarray:
        return words[starts[rows] + np.minimum(8 * (depth - 1), lengths[rows] - 8)].astype(np.uint64) if depth else group[rows].astype(np.uint64)

    while todo:
        rows, depth = todo.pop()
        if len(rows) <= small or depth > last:
            own = np.zeros(len(rows), np.int64)
            while depth <= last and len(rows) > 1:
                k = key(rows, depth)
                order = np.lexsort((k, own))
                rows, own, k = rows[order], own[order], k[order]
                own = np.cumsum(np.concatenate([[True], (own[1:] != own[:-1]) | (k[1:] != k[:-1])])) - 1
                tied = np.bincount(own)[own] > 1
                rows, own, depth = rows[tied], own[tied], depth + 1
            if len(rows) > 1:
                found.append((rows, own))
            continue
        k = key(rows, depth)
        some = np.sort(k[:: max(1, len(k) >> 10)])
        pivot = some[len(some) // 2]
        todo += [(rows[k > pivot], depth), (rows[k == pivot], depth + 1), (rows[k < pivot], depth)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    above = np.cumsum([0, *[int(own[-1]) + 1 for _, own in found]])
    return np.concatenate([r for r, _ in found]), np.concatenate([own + a for (_, own), a in zip(found, above, strict=False)])


def later_ones(rows: np.ndarray, group: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of each group of equal rows all but the first by the keys of `order` (the first key counts most)."""
    if not len(rows):
        return rows
    by = np.lexsort((*[k[rows] for k in reversed(order)], group))
    rows, group = rows[by], group[by]
    return rows[np.concatenate([[False], group[1:] == group[:-1]])]


def numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each distinct combination of keys."""
    by = np.lexsort(keys)
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


class Block:
    """A block's documents end to end, with their anchors; the same in every step that reads the block."""

    def __init__(self, payloads: pa.ChunkedArray):
        self.ids, texts = B.documents_in(payloads)
        self.raw = b"".join(texts)
        self.text = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
        #: What orders documents everywhere: no id, id, hash of the text.
        self.order = np.array([i is None for i in self.ids], np.uint8), np.array([i or 0 for i in self.ids], np.int64), np.array([B.text_hash(t) for t in texts], np.uint64)
        self.at, self.hash, self.first, self.last = anchors(self.text, self.ends)
        self.grams, self.gram, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)
        self.words = words_at(self.text, ">u8")

    def repeats(self) -> np.ndarray:
        """Whether an anchor's whole context occurs earlier in the block."""
        out = np.zeros(len(self.at), bool)
        which = np.flatnonzero(self.count[self.gram] > 1)
        if len(which):
            length = self.last[which] + SPAN - self.first[which]
            group = numbered(length, self.at[which] - self.first[which], self.gram[which])
            out[which[later_ones(*multikey_quicksort(self.words, self.first[which], length, group), (which,))]] = True
        return out

    def bytes_at(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.text[ranges(first, n)]

    def suffixes(self, at: np.ndarray, width: int) -> np.ndarray:
        """The leading bytes of suffixes, as byte strings."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, width)[at]).view(f"S{width}").ravel() if len(at) else np.zeros(0, f"S{width}")


def _ask(table: pa.Table, parts: int) -> pa.Table:
    block = Block(table.column("payload"))
    part = ((block.grams >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
    values = [B.pack_arrays(block.grams[g], np.minimum(block.count[g], 255).astype(np.uint8)) for g in groups]
    return pa.table({"part": pa.array([int(part[g[0]]) for g in groups], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(groups), pa.int32()), "grams": pa.array(values, pa.binary())})


def _own(table: pa.Table, hot: int) -> pa.Table:
    """For each asked gram 0: it is in one place, 1: in more, 2: in more than `hot`."""
    asked = [B.unpack_arrays(x.as_py()) for x in table.column("grams")]
    _, inverse = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([c for _, c in asked]))
    verdict = ((total > 1).astype(np.uint8) + (total > hot))[inverse].astype(np.uint8)
    cuts = np.cumsum([len(a) for a, _ in asked])[:-1]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "verdict": pa.array([B.pack_arrays(v) for v in np.split(verdict, cuts)], pa.binary())})


def _send(left: pa.Table, right: pa.Table, parts: int, splitters: np.ndarray) -> pa.Table:
    block = Block(left.column("payload"))
    replies = sorted(zip(right.column("part").to_pylist(), right.column("verdict").to_pylist(), strict=True))
    part = ((block.grams >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    verdict = np.zeros(len(block.grams), np.uint8)
    if replies:
        verdict[np.argsort(part, kind="stable")] = np.concatenate([B.unpack_arrays(v)[0] for _, v in replies])
    verdict = verdict[block.gram]
    which = np.flatnonzero((verdict > 0) & ~block.repeats())
    hot = verdict[which] == 2
    which, hot = which[~hot], which[hot]
    bucket = np.searchsorted(splitters.astype(f"S{GRAM}"), block.suffixes(block.at[which], GRAM), side="right")
    string = ranges(block.first[hot], block.last[hot] - block.first[hot] + 1)
    here = later_ones(*multikey_quicksort(block.words, string, np.full(len(string), SPAN), np.zeros(len(string), np.int64)), (string,))
    marked = string[here]  # strings that the block itself has earlier
    string = np.delete(string, here)
    string_bucket = np.searchsorted(splitters, block.suffixes(string, SPAN), side="right")
    mine, rows = left.column("block")[0].as_py(), []
    for b in np.union1d(bucket, string_bucket).tolist():
        own, lone = which[bucket == b], string[string_bucket == b]
        first, length = block.first[own], block.last[own] + SPAN - block.first[own]
        doc, lone_doc = (np.searchsorted(block.ends, at, side="right") for at in (block.at[own], lone))
        value = B.pack_arrays(
            own.astype(np.uint32), *[k[doc] for k in block.order], block.at[own].astype(np.uint32), (block.at[own] - first).astype(np.uint8), length.astype(np.uint8), block.bytes_at(first, length),
            lone.astype(np.uint32), *[k[lone_doc] for k in block.order], block.bytes_at(lone, np.full(len(lone), SPAN)),
        )
        rows.append((b, mine, value))
    if len(marked):
        rows.append((-1 - mine % (len(splitters) + 1), mine, B.pack_arrays(marked.astype(np.uint32))))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), "anchors": pa.array(columns[2], pa.binary())})


def _joined(rows: list[list[np.ndarray]], columns: tuple[int, ...]) -> list[np.ndarray]:
    return [np.concatenate([r[k] for r in rows]) for k in columns]


def _compare(table: pa.Table) -> pa.Table:
    """For each block: anchors all of whose strings occur earlier, and positions of single strings that do."""
    blocks = table.column("block").to_pylist()
    rows = [B.unpack_arrays(x.as_py()) for x in table.column("anchors")]
    full: list[list[np.ndarray]] = [[] for _ in rows]
    single: list[list[np.ndarray]] = [[] for _ in rows]

    def tell(out: list[list[np.ndarray]], owner: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(owner, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else []:
            out[owner[part[0]]].append(values[part].astype(np.uint32))

    if table.column("bucket")[0].as_py() < 0:
        single = [[r[0]] for r in rows]
    else:
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        number, null, ids, text_hash, at, distance, length = _joined(rows, (0, 1, 2, 3, 4, 5, 6))
        at, distance, length = at.astype(np.int64), distance.astype(np.int64), length.astype(np.int64)
        start = np.cumsum(length) - length
        words = words_at(np.concatenate([*_joined(rows, (7,)), np.zeros(8, np.uint8)]), ">u8")
        order = (null, ids, text_hash, at)
        found, gram = multikey_quicksort(words, start + distance, np.full(len(start), GRAM), np.zeros(len(start), np.int64))
        same = multikey_quicksort(words, start[found], length[found], numbered(length[found], distance[found], gram)) if len(found) else (found, gram)
        later = later_ones(*same, tuple(k[found] for k in order))
        tell(full, owner[found[later]], number[found[later]])
        heads, gram = np.delete(found, later), np.delete(gram, later)
        if len(heads):
            several = np.bincount(gram)[gram] > 1
            heads, gram = heads[several], gram[several]
        strings = length[heads] - SPAN + 1
        cut = [0]
        if len(heads):  # batches of whole groups
            total, ends = np.cumsum(strings), np.flatnonzero(np.concatenate([np.diff(gram) != 0, [True]])) + 1
            for e in ends.tolist():
                if total[e - 1] - (total[cut[-1] - 1] if cut[-1] else 0) >= BATCH or e == len(heads):
                    cut.append(e)
        for a, b in zip(cut, cut[1:], strict=False):
            own, n = heads[a:b], strings[a:b]
            which = np.repeat(np.arange(len(own)), n)
            k = ranges(np.zeros(len(own), np.int64), n)
            away = distance[own][which] - k  # the start's distance from the anchor
            later = later_ones(*multikey_quicksort(words, start[own][which] + k, np.full(len(which), SPAN), gram[a:b][which] * 256 + away + 128), tuple(x[own][which] for x in order))
            tell(single, owner[own[which[later]]], (at[own[which]] - away)[later])
        owner = np.repeat(np.arange(len(rows)), [len(r[8]) for r in rows])
        at, null, ids, text_hash = _joined(rows, (8, 9, 10, 11))
        words = words_at(np.concatenate([*_joined(rows, (12,)), np.zeros(8, np.uint8)]), ">u8")
        later = later_ones(*multikey_quicksort(words, SPAN * np.arange(len(at)), np.full(len(at), SPAN), np.zeros(len(at), np.int64)), (null, ids, text_hash, at))
        tell(single, owner[later], at[later])
    none = [np.zeros(0, np.uint32)]
    told = [k for k in range(len(rows)) if full[k] or single[k]]
    marks = [B.pack_arrays(np.concatenate(full[k] or none), np.concatenate(single[k] or none)) for k in told]
    return pa.table({"block": pa.array([blocks[k] for k in told], pa.int32()), "marks": pa.array(marks, pa.binary())})


def covered(whole: tuple[np.ndarray, np.ndarray], single: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` bytes strings of SPAN bytes cover: those that start from a first to a last place (apart from each
    other), and at single places. Arrays of one and four bytes for each byte, however many strings there are."""
    edge = np.zeros(size + 1, np.int8)
    edge[whole[0]] += 1
    edge[whole[1] + 1] -= 1
    starts = np.cumsum(edge[:-1], dtype=np.int8)
    starts[single] = 1
    total = starts.astype(np.int32)
    del edge, starts
    np.cumsum(total, out=total)  # may wrap around: only differences of up to SPAN matter
    out = total != 0
    out[SPAN:] = total[SPAN:] != total[:-SPAN]
    return out


def _cut(left: pa.Table, right: pa.Table, changed_only: bool) -> pa.Table:
    """changed_only: kept is null where nothing goes."""
    block = Block(left.column("payload"))
    whole, single = block.repeats(), [np.zeros(0, np.uint32)]
    for value in right.column("marks"):
        full, some = B.unpack_arrays(value.as_py())
        whole[full] = True
        single.append(some)
    gone = covered((block.first[whole], block.last[whole]), np.concatenate(single), len(block.text))
    out = []
    for doc_id, text_hash, a, b in zip(block.ids, block.order[2].view(np.int64).tolist(), np.concatenate([[0], block.ends[:-1]]).tolist(), block.ends.tolist(), strict=True):
        own = gone[a:b]
        spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
        kept = block.text[a:b][~own].tobytes() if spans else None if changed_only else block.raw[a:b]
        out.append((doc_id, b - a, int(own.sum()), spans, kept, text_hash))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text_hash"), columns, kinds, strict=True)})


def sample_splitters(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """buckets - 1 or fewer suffixes of up to SPAN bytes that bound the buckets, from a bounded sample of whole documents."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0):
                own = t.as_py()
                at = anchors(np.frombuffer(own, np.uint8), np.array([len(own)]))[0]
                found += [own[a : a + SPAN] for a in at[:: max(1, len(at) // SAMPLE_EACH)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["lead"])

    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select(text_of(text).cast("binary").alias("text")).limit(4 * SAMPLE_DOCS)
    found = np.sort(np.array([bytes(r[0]) for r in chosen.mapInArrow(leads, "lead binary").limit(8 * SAMPLE_DOCS * SAMPLE_EACH).collect()], f"S{SPAN}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def cut_repeats(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), text_hash (xxhash64 of the text) for every row of docs.

    A byte goes when a string of SPAN bytes covers it that starts earlier too: in a smaller doc_id, or earlier in the same
    document. Null texts count as empty; null ids come last. Rows that share a doc_id, or have none, come in the order of
    their texts' hashes, and rows that are alike one after the other. Other columns are ignored; an empty table gives an
    empty result. A text may have any length that a Spark string has; a task holds one document and a few arrays of its size.
    """
    return _cut_blocks(docs, text, hot, _cut_schema("kept binary"), lambda a, b: _cut(a, b, False))


def cut_texts(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """cut_repeats(docs) with `text` in place of kept: null where nothing goes, else what kept_texts() makes of kept.

    The task that cuts a text makes it a text too: texts that stay as they are leave no task, and no second one runs beside it.
    """
    return _cut_blocks(docs, text, hot, _cut_schema("text string"), lambda a, b: _with_texts(_cut(a, b, True)))


def _cut_schema(left: str) -> str:
    return f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {left}, text_hash bigint"


def _cut_blocks(docs: DataFrame, text: str, hot: int, schema: str, cut: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    parts = B.part_count(docs, text, BUCKET_BYTES)
    splitters = sample_splitters(docs, parts, text)
    blocks = B.blocks_of(docs, text)
    asked = blocks.groupBy("block").applyInArrow(lambda t: B.released(_ask(t, parts)), "part int, block int, grams binary")
    told = asked.groupBy("part").applyInArrow(lambda t: B.released(_own(t, hot)), "block int, part int, verdict binary")
    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: B.released(_send(a, b, parts, splitters)), "bucket int, block int, anchors binary")
    marks = sent.groupBy("bucket").applyInArrow(lambda t: B.released(_compare(t)), "block int, marks binary")
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda a, b: B.released(cut(a, b)), schema)


def _characters(kept: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of these bytes, without bytes that form no character."""
    return pa.array([x.as_py().decode("utf-8", "ignore") if x.is_valid else None for x in kept], pa.string())


def _with_texts(cut: pa.Table) -> pa.Table:
    at = cut.column_names.index("kept")
    return cut.set_column(at, "text", _characters(cut.column(at)))


def kept_texts(cut: DataFrame) -> DataFrame:
    """rows of cut_repeats with the text that is left; bytes that no longer form a character are left out. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _characters(batch.column("kept"))], [*keep, "text"])

    keep = [c for c in cut.columns if c != "kept"]
    return cut.mapInArrow(run, ", ".join([*(f"{c} bigint" for c in keep), "text string"]))
