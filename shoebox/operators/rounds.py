"""Loops over DataFrames: checkpoints in the shared folder, pointer jumping, reachability."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges whose components one task finds (16 bytes each).
LOCAL_EDGES = 1 << 18

#: The temporary folder of each application that has no shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, a temporary one will do."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found and not (context.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found and context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-shoebox-')}"
    return found or _LOCAL[context.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; later reads survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Frees what finished steps have left. Spark deletes shuffles, broadcasts and checkpoints once the driver has collected
    the DataFrames that led to them, which a driver puts off until its memory is full. What a first pass frees holds the rest."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both. Estimates know neither the rows that explode() makes nor, after a checkpoint,
    those that are there, so a side as long as the table might be broadcast through the driver."""
    return df.hint("merge")


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], int]) -> DataFrame:
    """step() again and again, each result materialised, until changed() counts nothing. Every step must come closer to the end."""
    while True:
        df = materialise(step(df))
        if not changed(df):
            return df


def roots(parents: DataFrame) -> DataFrame:
    """parents: node, parent (itself at a root). Returns node, root after log2(depth) self-joins."""

    def jump(p: DataFrame) -> DataFrame:
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        return p.select("node", "parent").join(apart(up), "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"))

    start = materialise(parents.select("node", "parent"))
    return until_stable(start, jump, lambda p: p.where("moved").limit(1).count()).select("node", F.col("parent").alias("root"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, root of the components of all edges (u, v) that come."""
    parts = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()], 1) for b in batches if b.num_rows]
    edges = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    ids, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    far = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "root"])


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """edges: u, v (long), in any direction and number. Returns u, root for every node that is not its component's least.

    Null ends and loops are ignored. Up to `local` distinct edges (counted) are joined in one task. More go through large-star
    and small-star rounds, about log(nodes) of them; each writes the edges to the shared folder, and the driver sees two numbers.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e)
    before = None
    now = _state(e)
    if now[0] <= local:
        return e.coalesce(1).mapInArrow(_roots, "u long, root long")
    while now != before:
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(apart(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.*")
        e = materialise(pairs.where(F.col("u") != F.col("v")).distinct())
        now = _state(e)
    return e.select("u", F.col("v").alias("root"))
