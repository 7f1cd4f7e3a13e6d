"""Exact deduplication through an extendible-hash index on shared files.

A directory of hash prefixes doubles until no bucket holds more than `capacity` distinct keys. Every bucket is a
range of 64-bit keys with one owner task, which chains entries whose keys collide, compares their bytes and writes the
bucket's entries to the shared folder. Copies are merged block by block where they are read, so that a text with any
number of copies reaches its owner once for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, block_count, in_parts, materialise, partitions, scratch, text_of

#: Distinct keys in a bucket before it splits; how many levels deeper than evenly spread keys need the directory begins, and grows
#: by while a bucket is still overfull.
CAPACITY, SPARE = 512, 2
#: A text of more copies is a hot one; so many hot texts at most are broadcast, so that their copies do not meet in one task.
HOT, HOT_TEXTS = 4096, 1 << 16
#: A directory of no more slots (16 bytes each) is broadcast, so that texts move once; a larger one is joined by a shuffle.
BROADCAST_SLOTS = 1 << 20
#: Bytes of distinct texts that a map task holds while it merges copies.
BLOCK_BYTES = 16 << 20
#: Bytes of texts for each owner task, at least where the session has partitions for more tasks.
OWNED_BYTES = 64 << 20
_INDEX = "bucket bigint, key bigint, chain int, keep_id bigint, group_size bigint, sha256 string, text string"


def normalised(text: str = "text"):
    return F.regexp_replace(text_of(text), BLANKS, " ")


def greatest_depth(keys: int, capacity: int = CAPACITY) -> int:
    """Bits of the longest prefix: as many as the number of distinct keys asks for, and SPARE for uneven ones."""
    return min(62, max(0, (max(1, -(-keys // capacity)) - 1).bit_length()) + SPARE)


def directory(keys: DataFrame, depth: int, capacity: int = CAPACITY) -> DataFrame:
    """slot, bucket: for each prefix of `depth` bits in use, the first of the slots that its bucket covers.

    All keys start in one bucket; every bucket with more than `capacity` keys splits by its next bit, and the directory
    doubles with the deepest of them. An overfull bucket's parents are overfull too, so a slot's bucket is as deep as the
    number of overfull prefixes that lead to it. keys: distinct keys. One row for each slot in use, never on the driver.
    """
    slots = keys.groupBy(prefix(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
    if not depth:
        return slots.select("slot", F.col("slot").alias("bucket"))
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - level)"))
    full = levels.groupBy("level", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("level", "prefix")
    deep = levels.join(full, ["level", "prefix"]).groupBy("slot").agg(F.count("*").cast("int").alias("d"))
    found = slots.join(deep, "slot", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return found.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - d), {depth} - d)").alias("bucket"))


def prefix(key: Column, depth: int) -> Column:
    """The leading bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), key (the same of the normalised text), sha256 of the normalised text."""
    rows = docs.select("doc_id", F.xxhash64(text_of(text)).alias("text_hash"), normalised(text).alias("_t"))
    return rows.select("doc_id", "text_hash", F.xxhash64("_t").alias("key"), F.sha2(F.col("_t").cast("binary"), 256).alias("sha256"))


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, keep_id, n, text: each distinct text of a block once, with its least doc_id and its rows."""
    held: dict[str, list] = {}
    size = 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[2] for v in held.values()], pa.int64()), pa.array(list(held), pa.string())],
            ["key", "keep_id", "n", "text"],
        )

    for batch in in_parts(batches):
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            entry = held.get(text)
            if entry is None:
                held[text] = [key, doc_id, 1]
                size += len(text)
            else:
                entry[2] += 1
                if doc_id is not None and (entry[1] is None or doc_id < entry[1]):
                    entry[1] = doc_id
            if size > BLOCK_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each key, sorted by bucket and key: equal bytes become one entry, others a chain."""
    chain: list[list] = []
    last = None

    def flush():
        shas = [hashlib.sha256(c[4].encode()).hexdigest() for c in chain]
        if len(set(shas)) < len(shas):
            raise ValueError("two different texts share a SHA-256 digest")
        return [(c[0], c[1], k, c[2], c[3], s, c[4]) for k, (c, s) in enumerate(zip(chain, shas, strict=True))]

    names = ["bucket", "key", "chain", "keep_id", "group_size", "sha256", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in in_parts(batches):
        for bucket, key, keep_id, n, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if key != last and chain:
                rows += flush()
                chain = []
            last = key
            for entry in chain:
                if entry[4] == text:
                    entry[3] += n
                    if keep_id is not None and (entry[2] is None or keep_id < entry[2]):
                        entry[2] = keep_id
                    break
            else:
                chain.append([bucket, key, keep_id, n, text])
        if rows:
            yield out()
            rows = []
    if chain:
        rows += flush()
        yield out()


def build_index(docs: DataFrame, keys: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Writes the index of docs to path (a shared folder) and returns it: one row for each distinct normalised text."""
    spark = docs.sparkSession
    distinct = materialise(keys.select("key").distinct())
    depth = greatest_depth(distinct.count(), capacity)
    while depth < 62 and not distinct.groupBy(prefix(F.col("key"), depth)).count().where(F.col("count") > capacity).isEmpty():
        depth = min(62, depth + SPARE)
    slots = materialise(directory(distinct, depth, capacity))
    rows = docs.select(F.col("doc_id").cast("bigint"), normalised(text).alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")
    entries = rows.mapInArrow(_merge_copies, "key bigint, keep_id bigint, n bigint, text string")
    slots = F.broadcast(slots) if slots.count() <= BROADCAST_SLOTS else slots
    owned = entries.withColumn("slot", prefix(F.col("key"), depth)).join(slots, "slot").select("bucket", "key", "keep_id", "n", "text")
    tasks = block_count(docs, text, OWNED_BYTES, partitions(spark))
    owned = owned.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
    owned.mapInArrow(_own, _INDEX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def exact_dedup(docs: DataFrame, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the text as it is) for every row of docs; text null counts as empty.

    Texts are equal when their bytes are, after each run of blanks became one space. The least doc_id of equal texts
    stays; null ids come after all others. Rows that repeat a doc_id count in group_size and share its verdict.
    Other columns of docs are ignored. An empty table gives an empty result. A text may have any length that a Spark string has.
    """
    keys = materialise(keyed(docs, text))
    index = build_index(docs, keys, scratch(docs.sparkSession, "exact-index"), text, capacity)
    found = index.select("key", "sha256", "keep_id", "group_size")
    on = ["key", "sha256"]
    hot = materialise(found.where(F.col("group_size") > HOT))
    if 0 < hot.count() <= HOT_TEXTS:
        rest = keys.join(F.broadcast(hot.select(*on)), on, "left_anti").join(found.where(F.col("group_size") <= HOT), on)
        out = keys.join(F.broadcast(hot), on).select(*rest.columns).union(rest)
    else:
        out = keys.join(found, on)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"), "text_hash")
