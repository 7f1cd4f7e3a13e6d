"""Exact similarity of sets of five-word shingles, for groups of candidates that simhash's shards bring together.

Groups are tested in rounds: few members against all others, then only what no link has joined yet, so that a large group
of copies costs a multiple of its size and no pair between unjoined members of a group is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_parts, let_go, materialise, sieve
from .components import components

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: In a group of at most so many members all pairs are tested at once.
SMALL = 16
#: Leading bits of a hash that sets move with; partners that one set meets in a task's run.
KEPT, PARTNERS = 40, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased text's word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = mixed(out + _STEP) + hashes[k : k + n]
    return np.unique(mixed(out))


def node_of(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def packed(found: np.ndarray) -> bytes:
    """A set of hashes in its KEPT leading bits, as compressed byte planes of the steps from one to the next.

    Two different hashes agree in KEPT bits once in 10**12, so a set of a million shingles may miss one in a million.
    """
    kept = np.unique(found >> np.uint64(64 - KEPT))
    steps = np.diff(kept, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpacked(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8).reshape(KEPT // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEPT // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(shingles(t.as_py())) for t in batch.column(1)], pa.binary())], ["node", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, part, q, hashes) by p and part, the set of p itself (q null) first: the pairs that are similar."""
    at, own = None, np.zeros(0, np.uint64)
    for batch in in_parts(batches):
        found = []
        for p, part, q, value in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            if q is None:
                at, own = (p, part), unpacked(value.as_py())
            elif at == (p, part) and similar(own, unpacked(value.as_py())):
                found.append((min(p, q), max(p, q)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the pairs (p, q) whose sets are similar. The set of p moves once for each PARTNERS of its pairs, not for every one."""
    pairs = materialise(pairs)
    many = materialise(pairs.groupBy("p").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("parts")))
    # Sets of no pair stay where they are.
    _, first = sieve(sets.withColumnRenamed("node", "p"), many, "p")
    _, second = sieve(sets.withColumnRenamed("node", "q"), materialise(pairs.select("q").distinct()), "q")
    own = first.join(many, "p").select("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("q"), "hashes")
    others = pairs.join(many, "p").select("p", F.pmod(F.xxhash64("q"), "parts").alias("part"), "q").join(second, "q").select("p", "part", "q", "hashes")
    met = own.union(others).repartition("p", "part").sortWithinPartitions("p", "part", F.asc_nulls_first("q"))
    return met.mapInArrow(_confirm, "u bigint, v bigint")


def links(members: DataFrame, sets: DataFrame, fps: DataFrame | None = None, bits: int = 0) -> DataFrame | None:
    """u, v: links that connect whatever similar pairs of a key connect. members: key, node, size; sets: node, hashes.

    fps (node, fps): fingerprints of the sets, arrays of longs. Pairs that differ in more than `bits` bits of them are too
    unlike for their sets to be brought together.
    """
    found = roots = None
    left, pivots = members, 1
    while not left.isEmpty():
        now = left.withColumn("root", F.col("node")) if roots is None else left.join(roots, left["node"] == roots["u"], "left").select(left["*"], F.coalesce("root", "node").alias("root"))
        whole = W.partitionBy("key")
        now = now.select("*", F.count("*").over(whole).alias("n"), F.min("root").over(whole).alias("low"), F.max("root").over(whole).alias("high"), F.count("*").over(W.partitionBy("key", "root")).alias("joined"))
        now = now.where("low <> high").withColumn("at", F.row_number().over(whole.orderBy("joined", F.xxhash64("node"), "node")))
        now = materialise(now.select("key", "node", "size", "root", "at", F.when(F.col("n") <= SMALL, F.col("n")).otherwise(F.lit(pivots)).alias("tested")))
        a, b = now.where("at <= tested").alias("a"), now.alias("b")
        near = F.least("a.size", "b.size") * SIMILAR[1] >= F.greatest("a.size", "b.size") * SIMILAR[0]
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.at") < F.col("b.at")) & (F.col("a.root") != F.col("b.root")) & near)
        pairs = pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"), F.struct(F.col("a.node").alias("p"), F.col("b.node").alias("q")).alias("pq")).groupBy("u", "v").agg(F.min("pq").alias("pq"))
        if fps is not None:
            pairs = pairs.join(fps.toDF("u", "x"), "u").join(fps.toDF("v", "y"), "v")
            pairs = pairs.where(F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x) <= bits)
        let_go(members.sparkSession)
        new = materialise(_similar_pairs(pairs.select("pq.p", "pq.q"), sets))
        let_go(members.sparkSession)
        found = new if found is None else found.union(new)
        left = now.where("at > tested").select("key", "node", "size")
        pivots *= 4
        if left.isEmpty():
            break
        roots = components(found)
    return found
