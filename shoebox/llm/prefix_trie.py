"""Prefix trie of conversations, as balanced parentheses per shard whose shared spines merge.

A turn is a 128-bit hash of its role and text; a node is the sum of the hashes of its turns and their depths. Conversations
are cut into segments of SEGMENT turns, equal segments below the same node are one sequence, and sequences in order of their
bytes are dealt to shards by range. A shard writes its part of the trie as parentheses in preorder. Blocks of least excess
find the parenthesis that closes a subtree; ranks then count its leaves, and differences of running sums give what it saves.

Only nodes on the path to a shard's first or last sequence can stand in another shard too. They, the roots of segments and
the nodes above a cut are the spine: its rows merge by key, and pointer doubling brings the sums of subtrees up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

#: Turns of a segment; turns that a task holds as one shard; conversation ids are joined 2**CHUNK_BITS at a time.
SEGMENT, SHARD, CHUNK_BITS = 256, 1 << 18, 12
#: Turns that a rebuilt conversation can take from its base.
HEAD = 8
#: Parentheses of a block.
BLOCK = 64
_NODES = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, bytes bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, ends_sha256 string, spine boolean, n_children bigint, n_leaves bigint, saved_tokens bigint"
_NAMES = [c.split()[0] for c in _NODES.split(", ")]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Parentheses:
    """A sequence of balanced parentheses (1 opens, 0 closes) with a tree over the least excess of its blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        n = max(1, -(-len(bits) // BLOCK))
        self.leaves = 1 << (n - 1).bit_length()
        padded = np.full(n * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(n, BLOCK)
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves : self.leaves + n] = self.blocks.min(1)
        level = self.leaves
        while level > 1:
            self.least[level // 2 : level] = self.least[level : 2 * level].reshape(-1, 2).min(1)
            level //= 2
        self.opens = np.flatnonzero(bits)
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            np.cumsum((bits[:-1] == 1) & (bits[1:] == 0), out=pairs[1:-1])
            pairs[-1] = pairs[-2]
        self.pairs = pairs

    def close(self, opens: np.ndarray) -> np.ndarray:
        """The place that closes each open parenthesis: the first later one of a lower excess than before it."""
        out = np.empty(len(opens), np.int64)
        for at in range(0, len(opens), 1 << 14):
            out[at : at + (1 << 14)] = self._close(opens[at : at + (1 << 14)])
        return out

    def _close(self, opens: np.ndarray) -> np.ndarray:
        goal = self.excess[opens] - 1
        block = opens // BLOCK
        hits = (self.blocks[block] <= goal[:, None]) & (np.arange(BLOCK)[None] > (opens % BLOCK)[:, None])
        inside = hits.any(1)
        out = block * BLOCK + hits.argmax(1)
        rest = np.flatnonzero(~inside)
        goal, node = goal[rest], block[rest] + self.leaves
        climbing = np.ones(len(rest), bool)
        while climbing.any():
            here = node[climbing]
            beside = (here % 2 == 0) & (self.least[np.minimum(here + 1, 2 * self.leaves - 1)] <= goal[climbing])
            node[climbing] = np.where(beside, here + 1, here // 2)
            climbing[np.flatnonzero(climbing)[beside]] = False
        while (below := node < self.leaves).any():
            left = 2 * node[below]
            node[below] = np.where(self.least[left] <= goal[below], left, left + 1)
        block = node - self.leaves
        out[rest] = block * BLOCK + (self.blocks[block] <= goal[:, None]).argmax(1)
        return out

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """How many "()" stand in each subtree."""
        return self.pairs[closes] - self.pairs[opens]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(turns: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each turn (16 bytes) and its depth."""
    lanes = np.frombuffer(turns, ">u8").astype(np.uint64).reshape(-1, 2)
    deep = _mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return _mix(lanes[:, 0] ^ deep), _mix(lanes[:, 1] + deep)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within a sorted partition, from 1."""
    last, n = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
        if ids[0] == last:
            at[: starts[1] if len(starts) > 1 else len(at)] += n
        last, n = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("conv_id"), pa.array(at, pa.int64()), batch.column("turn_key"), batch.column("bytes")], ["task", "conv_id", "at", "turn_key", "bytes"])


def ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, turn_key, bytes) of every turn, places from 1, and (conv_id, length).

    Turns are ordered by turn (null first), then role and text (null as empty). They are sorted by range, so a conversation
    of any length is shared by several tasks; where it crosses from task to task, at most twice as many numbers as there are
    tasks tell how many of its turns came before. Rows without conv_id are left out.
    """
    spark = turns.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    rows = rows.select("conv_id", F.spark_partition_id().alias("task"), key.alias("turn_key"), F.octet_length("text").cast("bigint").alias("bytes"))
    rows = materialise(rows.mapInArrow(_index, "task int, conv_id bigint, at bigint, turn_key binary, bytes bigint"))
    held = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.sum("n").alias("length"), F.sort_array(F.collect_list(F.struct("task", "n"))).alias("tasks"))
    shared = held.where(F.size("tasks") > 1).select("conv_id", F.explode(F.transform("tasks", lambda x, k: F.struct(x["task"].alias("task"), F.aggregate(F.slice("tasks", 1, k), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("before")))).alias("x")).select("conv_id", "x.*")
    rows = rows.join(F.broadcast(shared), ["conv_id", "task"], "left")
    return rows.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "turn_key", "bytes"), held.select("conv_id", "length")


def rebuilt(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c has the first h turns of c - c % 5, then its own after its first h; h = crc32(c) % 9."""
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)})
    of = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = materialise(convs.join(of, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0)))))
    heads = rows.where((F.col("conv_id") % 5 == 0) & (F.col("place") <= HEAD)).withColumnRenamed("conv_id", "base")
    first = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("place <= taken").select("conv_id", "place", "turn_key", "bytes")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_key", "bytes")
    return first.union(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))


def _digest(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for c, s, length, turns in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "length", "turns")), strict=True):
                keys = b"".join(t["turn_key"] for t in turns)
                a, b = _lanes(keys, segment * s + 1 + np.arange(len(turns)))
                sizes = np.array([t["bytes"] for t in turns], np.int64)
                rows.append((c, s, s == max(0, length - 1) // segment, keys, sizes.tobytes(), int(a.sum().astype(np.int64)), int(b.sum().astype(np.int64))))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["conv_id", "segment", "last", "keys", "sizes", "d1", "d2"])

    return run


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the digests before each segment; rows come by conversation and segment."""
    last, held = None, np.zeros(2, np.uint64)
    for batch in batches:
        out = []
        for c, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "d1", "d2")), strict=True):
            if c != last:
                last, held = c, np.zeros(2, np.uint64)
            out.append(held)
            held = held + np.array([a, b], np.int64).view(np.uint64)
        sums = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["conv_id", "segment", "r1", "r2"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path: the key of the node above a segment, then its turns; e1, e2: the key of its last node."""
    for batch in batches:
        r1, r2, d1, d2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("r1", "r2", "d1", "d2"))
        roots = np.stack([r1, r2], 1).astype(">u8").tobytes()
        paths = [roots[16 * k : 16 * k + 16] + keys for k, keys in enumerate(batch.column("keys").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array((r1 + d1).view(np.int64)), pa.array((r2 + d2).view(np.int64)), pa.array(paths, pa.binary()), *(batch.column(c) for c in ("sizes", "segment", "conv_id", "last"))], ["e1", "e2", "path", "sizes", "segment", "conv_id", "last"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each key, which come in order; a task holds one chunk and one hash state."""
    key, state, done = None, hashlib.sha256(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], ["e1", "e2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("e1", "e2", "ids")), strict=True):
            if (a, b) != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield out()
        done = []
    if key is not None:
        done.append((key, state.hexdigest()))
    yield out()


def sequences(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """e1, e2, path, sizes, segment, n, conv_id, n_ends, ends_sha256: each distinct segment below its node once, with its conversations."""
    long = (convs.agg(F.max("length")).first()[0] or 0) > segment
    cut = F.expr(f"(place - 1) div {segment}").alias("segment")
    parts = rows.select("conv_id", cut, "place", "turn_key", "bytes").groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "turn_key", "bytes"))).alias("turns"))  # at most `segment` turns
    none = F.array().cast("array<struct<place:bigint,turn_key:binary,bytes:bigint>>")
    parts = parts.join(convs, "conv_id").select("conv_id", "segment", "length", "turns").union(convs.where("length = 0").select("conv_id", F.lit(0).cast("bigint"), "length", none))
    parts = parts.mapInArrow(_digest(segment), "conv_id bigint, segment bigint, last boolean, keys binary, sizes binary, d1 bigint, d2 bigint")
    zero = F.lit(0).cast("bigint")
    if long:
        parts = materialise(parts)
        many = parts.where("NOT last OR segment > 0").select("conv_id", "segment", "d1", "d2").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        roots = many.mapInArrow(_carry, "conv_id bigint, segment bigint, r1 bigint, r2 bigint")
        parts = parts.join(roots, ["conv_id", "segment"], "left").withColumns({"r1": F.coalesce("r1", zero), "r2": F.coalesce("r2", zero)})
    else:
        parts = parts.withColumns({"r1": zero, "r2": zero})
    parts = materialise(parts.mapInArrow(_placed, "e1 bigint, e2 bigint, path binary, sizes binary, segment bigint, conv_id bigint, last boolean"))
    chunk = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")  # at most 2**CHUNK_BITS ids
    ends = parts.where("last").groupBy("e1", "e2", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(chunk)
    ends = ends.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "chunk").select("e1", "e2", "ids").mapInArrow(_hashed, "e1 bigint, e2 bigint, ends_sha256 string")
    found = parts.groupBy("e1", "e2").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.first("segment").alias("segment"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.col("last").cast("bigint")).alias("n_ends"))
    return found.join(ends, ["e1", "e2"], "left")


def _least_of(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for ranges that are not empty, by minima over powers of two."""
    tables = [values]
    while 2 ** len(tables) <= len(values):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    out = np.empty(len(start), values.dtype)
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(tables[k][start[own]], tables[k][stop[own] - 2**k])
    return out


def _shard(held: list[tuple], segment: int) -> pa.RecordBatch:
    """The nodes of sequences (path, sizes, segment, n, conv_id, n_ends, ends_sha256) in order of their paths."""
    paths, sizes, segments, n, conv, n_ends, sha = zip(*held, strict=True)
    count = len(held)
    length = np.array([len(p) // 16 for p in paths])  # nodes of a path, the node above its segment included
    start = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(count), length)
    rel = np.arange(start[-1]) - start[:-1][owner]
    depth = np.array(segments, np.int64)[owner] * segment + rel
    raw = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    k1, k2 = _lanes(b"".join(paths), depth)
    top = rel == 0
    k1, k2 = np.where(top, raw[:, 0], k1), np.where(top, raw[:, 1], k2)
    for lane in (k1, k2):
        np.cumsum(lane, out=lane)
        lane -= np.concatenate([[np.uint64(0)], lane])[start[:-1]][owner]
    size = np.zeros(start[-1], np.int64)
    size[~top] = np.frombuffer(b"".join(sizes), np.int64)
    # Nodes that a path shares with the path before it.
    common = np.minimum(length[1:], length[:-1])
    step = np.arange(common.sum()) - np.repeat(np.cumsum(common) - common, common)
    before, after = np.repeat(start[:-2], common) + step, np.repeat(start[1:-1], common) + step
    shared = np.zeros(count, np.int64)
    if count > 1:
        shared[1:] = np.add.reduceat(((k1[before] == k1[after]) & (k2[before] == k2[after])).astype(np.int64), np.cumsum(common) - common)
    node = np.flatnonzero(rel >= shared[owner])  # in preorder
    rank = np.empty(start[-1], np.int64)
    rank[node] = np.arange(len(node))
    closes = np.append(0, np.append(length[:-1] - shared[1:], length[-1]))
    bits = np.repeat(np.tile([0, 1], count + 1)[:-1].astype(np.uint8), np.ravel(np.column_stack([closes, np.append(length - shared, 0)]))[:-1])
    tree = Parentheses(bits)
    close = tree.close(tree.opens)
    first, stop = np.arange(len(node)), np.arange(len(node)) + (close - tree.opens + 1) // 2  # each subtree in preorder
    last_node = rank[start[1:] - 1]  # of each sequence

    def within(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[stop] - total[first]

    def at_ends(values) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        out[last_node] = values
        return out

    passing = np.array(n, np.int64)
    n_convs, n_paths = within(at_ends(passing)), within(at_ends(1))
    least = _least_of(np.array(conv, np.int64), owner[node], owner[node] + n_paths)
    n_rel, n_size, n_depth = rel[node], size[node], depth[node]
    own = (n_convs - 1) * n_size
    saved, leaves = within(own), tree.leaf_pairs(tree.opens, close)
    spine = (n_rel == 0) | (within(at_ends(passing - np.array(n_ends, np.int64))) > 0)
    spine[: length[0]] = True
    parent, path = np.full(len(node), -1), np.zeros(int(length.max()), np.int64)
    for k in range(count):
        a, b = int(shared[k]), int(length[k])
        i = rank[start[k] + a]
        path[a:b] = np.arange(i, i + b - a)
        parent[i + 1 : i + b - a] = path[a : b - 1]
        if a:
            parent[i] = path[a - 1]
    spine[path[: length[-1]]] = True
    below = np.flatnonzero((parent >= 0) & ~spine)
    hung = np.zeros((3, len(node)), np.int64)  # children, leaves and savings of the children that are not in the spine
    for row, values in zip(hung, (1, leaves[below], saved[below]), strict=True):
        np.add.at(row, parent[below], values)
    children = np.bincount(parent[parent >= 0], minlength=len(node))
    deep_root = (n_rel == 0) & (n_depth > 0)  # counted where the segment above it ends
    ends: list[str | None] = [None] * len(node)
    for k in range(count):
        if n_ends[k]:
            ends[last_node[k]] = sha[k]
    loose = ~spine & ~spine[np.maximum(parent, 0)]  # nothing outside the shard is needed
    s1, s2 = k1[node].view(np.int64), k2[node].view(np.int64)
    up = np.maximum(parent, 0)
    masked = lambda v, hide: pa.array(v, pa.int64(), mask=hide)
    columns = [
        masked(s1, ~spine), masked(s2, ~spine), masked(s1[up], loose | (parent < 0)), masked(s2[up], loose | (parent < 0)), pa.array(n_depth), pa.array(n_size), masked(least, deep_root), masked(least[up], ~loose),
        pa.array(np.where(deep_root, 0, n_convs)), pa.array(ends, pa.string()), pa.array(spine), *(pa.array(np.where(spine, a, b)) for a, b in zip(hung, (children, leaves, saved), strict=True)),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _shards(segment: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "segment", "n", "conv_id", "n_ends", "ends_sha256")), strict=True):
                held.append(row)
                turns += len(row[0]) // 16
                if turns >= shard:
                    yield _shard(held, segment)
                    held, turns = [], 0
        if held:
            yield _shard(held, segment)

    return run


def _merged(rows: DataFrame) -> DataFrame:
    """The spine's nodes: k1, k2, p1, p2, depth, conv_id and the final numbers of each."""
    spine = rows.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "depth", "bytes", "ends_sha256")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    spine = materialise(spine)
    inner = spine.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("inner"))
    spine = spine.join(inner, ["k1", "k2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own = {"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")}
    spine = materialise(spine.drop("inner").withColumns(own))
    sums = spine.select("k1", "k2", "p1", "p2", "n_leaves", "saved_tokens")
    while not sums.where("p1 IS NOT NULL").isEmpty():
        up = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
        add = sums.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        sums = sums.join(add, ["k1", "k2"], "left").join(up, ["p1", "p2"], "left")
        zero = F.lit(0)
        sums = materialise(sums.select("k1", "k2", F.col("g1").alias("p1"), F.col("g2").alias("p2"), (F.col("n_leaves") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", zero)).alias("saved_tokens")))
    return materialise(spine.drop("n_leaves", "saved_tokens").join(sums.select("k1", "k2", "n_leaves", "saved_tokens"), ["k1", "k2"]))


def trie(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """COLUMNS for every node of the trie of conversations: rows (conv_id, place, turn_key, bytes) and convs (conv_id, length)."""
    spark = rows.sparkSession
    convs = materialise(convs)
    n, turns = convs.agg(F.count("*"), F.sum("length")).first()
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in COLUMNS))
    parts = max(partitions(spark), -(-(turns or 0) // shard))
    own = sequences(rows, convs, segment).repartitionByRange(parts, "path").sortWithinPartitions("path")
    nodes = materialise(own.mapInArrow(_shards(segment, shard), _NODES))
    spine = _merged(nodes.where("spine"))
    above = spine.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    hanging = nodes.where("NOT spine AND p1 IS NOT NULL").drop("parent_conv_id").unionByName(spine, allowMissingColumns=True).join(above, ["p1", "p2"], "left").withColumnRenamed("above", "parent_conv_id")
    found = nodes.where("NOT spine AND p1 IS NULL").select(*COLUMNS).union(hanging.select(*COLUMNS))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def prefix_trie(turns: DataFrame, share: bool = False, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node.

    A node is a distinct sequence of the first turns (role and text) of some conversation; conv_id is its least member. With
    share, conversations are rebuilt() first. Turns are ordered by turn (null first); turns of equal number by role and
    text. Null roles and texts are empty; repeated rows are turns of their own; rows without conv_id are left out. An
    empty table has no nodes. Texts and conversations may have any length; only hashes of turns move after the first
    sort. A conversation without turns (possible with share only) is a member of the root. Other columns are ignored.
    """
    rows, convs = ranked(turns)
    return trie(*(rebuilt(rows, convs) if share else (rows, convs)), segment, shard)
