"""Near-duplicates by SimHash: exact pairs of close fingerprints through vantage-point trees.

Two 64-bit fingerprints that differ in at most MAX_BITS = 4 bits differ in at most 1 bit of some block of 22, 21 or 21
bits. For each block a vantage-point tree, fitted on a bounded sample, splits the Hamming space of that block: points as
close to the vantage point as the median go left, the others right. Every fingerprint is a member of one leaf; where the
triangle inequality lets a partner stand beyond a boundary, it is also sent across as a query. Leaves are shards: each
goes on splitting by the same rule, compares whole fingerprints, and returns a spanning star of each linked group.

near_copies() uses the same trees for a similarity of sets of shingles: LANES fingerprints of 128 bits, each with its own
hash, hold six blocks; a pair of sets at similarity 0.8 differs in 15 % of the bits, so that each block brings it together
with a probability of 0.13. What the shards group is then compared set by set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import give_back, in_parts, let_go, materialise, sieve, text_of
from .components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: (mask, radius) of each block; radius * 3 + 2 >= MAX_BITS.
BLOCKS = (((1 << 22) - 1, 1), (((1 << 21) - 1) << 22, 1), (((1 << 21) - 1) << 43, 1))
#: A shard is to hold about so many members; a tree is fitted on so many fingerprints for each of its shards, and on SAMPLE at
#: least. Both grow with the table until a tree has 2**MAX_DEPTH shards, which is what a driver holds with ease.
SHARD, PER_SHARD, SAMPLE, MAX_DEPTH = 1024, 8, 8192, 17
#: A shard of more rows is dealt into groups, and every two groups meet in a task of their own.
CROWDED = 1 << 14
#: near_copies(): pairs that differ in more of all 768 bits are not compared as sets; at a similarity of 0.8, 116 bits differ, and
#: 144 where sets have four or five members, give or take 10.
FAR = 184
#: 128-bit fingerprints of a set; bits of 96 in which two of them may differ to be compared (a word and half of the other); a tree's greatest depth
#: (36 trees go to every task) and the most sets that they are fitted on.
LANES, LANE_BITS, LANE_DEPTH, LANE_SAMPLE = 6, 22, 12, 1 << 16
#: Close pairs for each node of a group of a shard up to which the pairs themselves are candidates.
SPARSE = 8
#: A shard splits on in its task until so few members are left.
SMALL = 96
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row; null texts count as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(text).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def distances(a: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


@dataclass(frozen=True)
class Node:
    """A leaf (number >= 0) or a split: points at distance <= near go left."""

    leaf: int = -1
    vantage: int = 0
    near: int = 0
    left: Node | None = None
    right: Node | None = None


def _split(points: np.ndarray, mask: int, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
    """Of a few vantage points the one that halves the points best: it, the near distance, the distances."""
    best = None
    for v in rng.choice(points, min(4, len(points)), replace=False).tolist():
        d = distances(points, v, mask)
        counts = np.cumsum(np.bincount(d, minlength=65))
        near = int(np.argmin(np.abs(counts - len(points) / 2)))
        if 0 < counts[near] < len(points) and (best is None or abs(counts[near] - len(points) / 2) < best[0]):
            best = (abs(counts[near] - len(points) / 2), v, near, d)
    return best and best[1:]


def build_tree(sample: np.ndarray, mask: int, depth: int, seed: int) -> tuple[Node, list[int]]:
    """A tree of at most 2**depth leaves over the sample; returns it and how many of the sample are in each leaf."""
    rng, leaves = np.random.default_rng(seed), []

    def grow(points: np.ndarray, left_depth: int) -> Node:
        found = _split(points, mask, rng) if left_depth and len(points) >= 8 else None
        if found is None:
            leaves.append(len(points))
            return Node(leaf=len(leaves) - 1)
        v, near, d = found
        return Node(vantage=v, near=near, left=grow(points[d <= near], left_depth - 1), right=grow(points[d > near], left_depth - 1))

    return grow(sample, depth), leaves


def visit(d: np.ndarray, member: np.ndarray, near: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who goes left, who of them as a member, and the same for the right.

    A member goes to its own side. Of two members that a boundary parts, the left one crosses it as a query. A query
    goes to each side where the triangle inequality leaves room for a partner.
    """
    own = d <= near
    left = np.where(member, own, d - radius <= near)
    right = np.where(member, ~own | (d + radius > near), d + radius > near)
    return left, member & own, right, member & ~own


def route(root: Node, fps: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows of fps, whether as members) for every leaf that some row visits."""
    todo = [(root, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        node, rows, member = todo.pop()
        if not len(rows):
            continue
        if node.leaf >= 0:
            yield node.leaf, rows, member
            continue
        left, lm, right, rm = visit(distances(fps[rows], node.vantage, mask), member, node.near, radius)
        todo += [(node.left, rows[left], lm[left]), (node.right, rows[right], rm[right])]


def close_pairs(fps: np.ndarray, member: np.ndarray, mask: int, radius: int, max_bits: int = MAX_BITS, seed: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows a, rows b) of a shard within max_bits: members with each other and with queries, in batches.

    fps: a 64-bit number for each row, or several of them (a matrix), of which the first holds the block.
    """
    rng = np.random.default_rng(seed)
    every = fps.reshape(len(fps), -1)
    fps = np.ascontiguousarray(every[:, 0])
    todo = [(np.arange(len(fps)), member)]
    while todo:
        rows, m = todo.pop()
        own = rows[m]
        if not len(own):
            continue
        found = _split(fps[own], mask, rng) if len(own) > SMALL else None
        if found is not None:
            left, lm, right, rm = visit(distances(fps[rows], found[0], mask), m, found[1], radius)
            todo += [(rows[left], lm[left]), (rows[right], rm[right])]
            continue
        others = np.concatenate([own, rows[~m]])
        step = max(1, (1 << 20) // len(others))
        for k in range(0, len(own), step):
            bits = np.zeros((len(own[k : k + step]), len(others)), np.uint16)
            for w in range(every.shape[1]):
                bits += np.bitwise_count(every[own[k : k + step], None, w] ^ every[None, others, w])
            a, b = np.nonzero(bits <= max_bits)
            ahead = b > a + k
            if ahead.any():
                yield own[k + a[ahead]], others[b[ahead]]


class Groups:
    """Union-find over row numbers by whole arrays; a group's root is its least row number."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _links(table: pa.Table, max_bits: int) -> pa.Table:
    """u, v: a star of each group that the shard's close pairs link; never more rows than the shard has."""
    tree = table.column("tree")[0].as_py()
    join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind)
    fps, reps, member = join("fps", np.uint64), join("reps", np.int64), join("members", np.uint8).astype(bool)
    order = np.argsort(reps, kind="stable")
    fps, reps, member = fps[order], reps[order], member[order]
    groups = Groups(len(reps))
    for a, b in close_pairs(fps, member, *BLOCKS[tree], max_bits):
        groups.join(a, b)
    linked = groups.root != np.arange(len(reps))
    return pa.table({"u": pa.array(reps[linked]), "v": pa.array(reps[groups.root[linked]])})


_SENT = "tree int, leaf int, one int, two int, fps binary, reps binary, members binary"


def _dealt(leaves: list[int], n: int, crowded: int) -> dict[int, int]:
    """Into how many groups the rows of each crowded leaf are dealt: as its share of the sample says, queries included.

    Every two groups meet in a task of their own, so that the number of groups decides sizes only, never what is found.
    """
    each = n / max(1, sum(leaves))
    return {leaf: -(-int(6 * size * each) // crowded) for leaf, size in enumerate(leaves) if 3 * size * each > crowded}


def _rows(tree: int, leaf: int, groups: dict[int, int], fps: np.ndarray, reps: np.ndarray, member: np.ndarray) -> Iterator[tuple]:
    """tree, leaf, one, two, fps, reps, members: the rows of a leaf, once for each pair of groups that they are in."""
    n = groups.get(leaf, 1)
    if n == 1:
        yield tree, leaf, 0, 0, fps.tobytes(), reps.tobytes(), member.tobytes()
        return
    group = ((fps.reshape(len(fps), -1)[:, 0].astype(np.uint64) * _MIX) >> np.uint64(40)) % np.uint64(n)
    for g in np.unique(group).tolist():
        rows = group == g
        parts = fps[rows].tobytes(), reps[rows].tobytes(), member[rows].tobytes()
        for h in range(n):
            if h != g:
                yield tree, leaf, min(g, h), max(g, h), *parts


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["tree", "leaf", "one", "two", "fps", "reps", "members"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """u, v over fps (fp, rep: distinct fingerprints, each with a document): every link within max_bits or a path of links.

    No link between different fingerprints is lost: u and v are connected exactly when links connect their fingerprints.
    """
    if max_bits >= sum(r + 1 for _, r in BLOCKS):
        raise ValueError("more differing bits than the blocks can find")
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, round(np.log2(max(1, n) / SHARD)))) if n else 0
    most = max(SAMPLE, PER_SHARD << depth)
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most).collect()], np.int64).view(np.uint64)
    trees = [build_tree(sample, mask, depth, seed) for seed, (mask, _) in enumerate(BLOCKS)]
    trees = [(tree, _dealt(leaves, n, crowded)) for tree, leaves in trees]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            rows = [row for t, (mask, radius) in enumerate(BLOCKS) for leaf, r, m in route(trees[t][0], own, mask, radius) for row in _rows(t, leaf, trees[t][1], own[r], reps[r], m.astype(np.uint8))]
            if rows:
                yield _batch(rows)

    return fps.select("fp", "rep").mapInArrow(send, _SENT).groupBy("tree", "leaf", "one", "two").applyInArrow(lambda t: _links(t, max_bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs: the least doc_id that links of max_bits or fewer bits reach.

    Null and wordless texts have fingerprint 0 and link like any other. A row with a null doc_id is not linked and gets a
    null component. Rows that repeat a doc_id with different texts are one document that has all their links. Other
    columns are ignored; an empty table gives an empty result. A text may have any length that a Spark string has. A bit of
    which exactly half the shingles have a 1 is 0.
    """
    own = materialise(fingerprints(docs, text, shingle))
    fps = materialise(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")))
    several = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    same = own.join(several.select("doc_id"), "doc_id").join(fps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(links(fps, max_bits).union(same))
    labelled = fps.join(roots, fps["rep"] == roots["u"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = own.join(labelled, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def majorities(own: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each of the hash functions `own`: the number whose bits are set in over half of its hashes of what was found.

    Bits are counted side by side: full adders turn three numbers of one weight into one of it and one of twice it.
    """
    rows, n = len(own), len(found)
    counts = np.zeros((rows, 64), np.int64)
    for k in range(0, n, 1 << 14):
        pending, weight = jaccard.mixed(found[None, k : k + (1 << 14)] + own), 1
        while pending.shape[1]:
            carried = []
            while pending.shape[1] > 64:
                m = pending.shape[1] // 3
                a, b, c = pending[:, :m], pending[:, m : 2 * m], pending[:, 2 * m : 3 * m]
                either = a ^ b
                carried.append((a & b) | (either & c))
                pending = np.concatenate([either ^ c, pending[:, 3 * m :]], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(pending).view(np.uint8), axis=1, bitorder="little").reshape(rows, -1, 64)
            counts += weight * bits.sum(1, dtype=np.int64)
            pending, weight = np.concatenate(carried, axis=1) if carried else pending[:, :0], 2 * weight
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def set_fingerprints(found: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """2 * lanes numbers: SimHashes of a set of 64-bit hashes under as many further hash functions."""
    own = np.arange(1, 2 * lanes + 1, dtype=np.uint64)[:, None] * _MIX
    return majorities(own, found)


def lane_groups(nodes: DataFrame, lanes: int = LANES, max_bits: int = LANE_BITS, crowded: int = CROWDED) -> DataFrame:
    """key, node for nodes (node, fps: an array of 2 * lanes longs): under each key, nodes to be compared.

    A group that a shard's close pairs connect is one key where it has more than SPARSE pairs for each node; of other groups,
    each pair is a key, so that chains of candidates do not bring all their nodes together.
    """
    n = nodes.count()
    depth = min(LANE_DEPTH, max(0, round(np.log2(max(1, n) / SHARD)))) if n else 0
    most = min(LANE_SAMPLE, max(SAMPLE, PER_SHARD << depth))
    rows = nodes.select("fps").orderBy(F.xxhash64("node"), "node").limit(most).collect()
    sample = np.array([r[0] for r in rows], np.int64).view(np.uint64).reshape(-1, 2 * lanes)
    kinds = [(lane, word, mask, radius) for lane in range(lanes) for word in range(2) for mask, radius in BLOCKS]
    trees = [build_tree(np.ascontiguousarray(sample[:, 2 * lane + word]), mask, depth, t) for t, (lane, word, mask, _) in enumerate(kinds)]
    trees = [(tree, _dealt(leaves, n, crowded)) for tree, leaves in trees]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 4000):
            own, reps = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, 2 * lanes), batch.column(0).to_numpy()
            rows = []
            for t, (lane, word, mask, radius) in enumerate(kinds):
                pair = own[:, 2 * lane : 2 * lane + 2].view(np.uint32)[:, [0, 1, 2] if word == 0 else [2, 3, 0]]  # its own word and half of the other
                rows += [row for leaf, r, m in route(trees[t][0], np.ascontiguousarray(own[:, 2 * lane + word]), mask, radius) for row in _rows(t, leaf, trees[t][1], np.ascontiguousarray(pair[r]), reps[r], m.astype(np.uint8))]
            if rows:
                yield _batch(rows)

    def group(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        _, _, mask, radius = kinds[tree]
        join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind)
        fps = np.zeros((table_rows := len(join("reps", np.int64)), 2), np.uint64)
        fps.view(np.uint32)[:, :3] = join("fps", np.uint32).reshape(table_rows, 3)
        reps, member = join("reps", np.int64), join("members", np.uint8).astype(bool)
        groups, near = Groups(len(reps)), np.zeros(len(reps), np.int64)
        for a, b in close_pairs(fps, member, mask, radius, max_bits):
            groups.join(a, b)
            np.add.at(near, a, 1)
            np.add.at(near, b, 1)
        size, pairs = np.bincount(groups.root, minlength=len(reps)), np.bincount(groups.root, near, len(reps)) / 2
        dense = (pairs > SPARSE * size)[groups.root]
        own = dense & (size[groups.root] > 1)
        place = np.array([tree, table.column("leaf")[0].as_py(), table.column("one")[0].as_py(), table.column("two")[0].as_py()], np.uint64)
        mixed = jaccard.mixed(reps[groups.root[own]].view(np.uint64))
        for x in (place + np.uint64(1)) * _MIX:
            mixed = jaccard.mixed(mixed + x)
        keys, found = [mixed.view(np.int64)], [reps[own]]
        if (~dense & (size[groups.root] > 1)).any():  # groups that hang together by few pairs send these
            for a, b in close_pairs(fps, member, mask, radius, max_bits):
                some = ~dense[a] & (reps[a] != reps[b])
                low, high = np.minimum(reps[a[some]], reps[b[some]]).view(np.uint64), np.maximum(reps[a[some]], reps[b[some]]).view(np.uint64)
                both = np.unique(np.stack([low, high], 1), axis=0)
                key = jaccard.mixed(jaccard.mixed(both[:, 0]) + both[:, 1]).view(np.int64)  # the same in every shard
                keys.append(np.repeat(key, 2))
                found.append(both.ravel().view(np.int64))
        give_back()
        return pa.table({"key": pa.array(np.concatenate(keys)), "node": pa.array(np.concatenate(found))})

    return nodes.select("node", "fps").mapInArrow(send, _SENT).groupBy("tree", "leaf", "one", "two").applyInArrow(group, "key bigint, node bigint").distinct()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        nodes, sizes, fps, hashes = [], [], [], []
        for t in batch.column(2):
            found = jaccard.shingles(t.as_py())
            nodes.append(jaccard.node_of(found))
            sizes.append(len(found))
            fps.append(set_fingerprints(found))
            hashes.append(xxhash.xxh64_intdigest(t.as_py(), SEED))  # Spark's xxhash64
        flat = pa.array(np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * LANES * len(fps) + 1, 2 * LANES, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(np.array(hashes, np.uint64).view(np.int64))], ["doc_id", "sha256", "node", "size", "fps", "text_hash"])


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sha256 and text_hash (xxhash64) of the text, kept for every row of docs: of each group of near copies the least doc_id, then the least sha256, stays.

    Near copies are linked by a Jaccard similarity of five-word shingles of 0.8 or more, or by a path of such links; every
    link is confirmed by the sets. Pairs come from the shards of LANES * 6 = 36 vantage-point trees: at a similarity of
    exactly 0.8 about one pair in 200 is missed, at 0.85 one in thousands.
    Null ids come after all others and link like them; rows that repeat a doc_id with different texts are rows of their own.
    Texts of less than five words are one shingle, so they link when their words are the same. Null texts count as empty.
    A text may have any length that a Spark string has. Other columns are ignored; an empty table gives an empty result.
    """
    sha = F.sha2(text_of(text).cast("binary"), 256)
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha.alias("sha256"), text_of(text).cast("binary").alias("text"))
    own = materialise(body.mapInArrow(_sign, "doc_id bigint, sha256 string, node bigint, size int, fps array<bigint>, text_hash bigint"))
    nodes = materialise(own.groupBy("node").agg(F.first("size").alias("size"), F.first("fps").alias("fps"), F.min("sha256").alias("sha256")))
    let_go(docs.sparkSession)
    members = materialise(lane_groups(nodes.select("node", "fps")).join(nodes.select("node", "size"), "node").select("key", "node", "size"))
    let_go(docs.sparkSession)  # the shards' rows
    wanted = materialise(nodes.join(members.select("node").distinct(), "node").select("node", "sha256"))
    _, some = sieve(body.select("sha256", "text"), wanted, "sha256")
    texts = some.join(wanted, "sha256").dropDuplicates(["sha256"])  # as the join deals them: texts move once, sets do not
    sets = materialise(texts.select("node", "text").mapInArrow(jaccard.sets, "node bigint, hashes binary"))
    let_go(docs.sparkSession)  # the texts
    found = jaccard.links(members, sets, nodes.join(wanted.select("node"), "node", "left_semi").select("node", "fps"), FAR)
    rows = own.select("doc_id", "sha256", "text_hash", "node")
    if found is not None:
        roots = components(found)
        let_go(docs.sparkSession)
        rows = rows.join(roots, rows["node"] == roots["u"], "left").select("doc_id", "sha256", "text_hash", F.coalesce("root", "node").alias("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha256"))
    first = rows.groupBy("node").agg(first.alias("r")).select(F.col("node").alias("of"), F.col("r.doc_id").alias("first_id"), F.col("r.sha256").alias("first_sha"))
    kept = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha256") == F.col("first_sha"))
    return rows.join(first, F.col("node") == F.col("of")).select("doc_id", "sha256", "text_hash", kept.alias("kept"))
