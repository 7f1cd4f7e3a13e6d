"""Highlights: this day in earlier years, the best of a month, trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rounds import materialise


def on_this_day(media: DataFrame, today: str, org: str = "org", id: str = "id", at: str = "taken_at") -> DataFrame:
    """org, year, n, newest: how many photos were taken on today's month and day in earlier years, and the latest of them."""
    now = F.to_date(F.lit(today))
    rows = media.where((F.month(at) == F.month(now)) & (F.dayofmonth(at) == F.dayofmonth(now)) & (F.year(at) < F.year(now)))
    return rows.groupBy(org, F.year(at).alias("year")).agg(F.count("*").alias("n"), F.max_by(id, F.struct(at, id)).alias("newest"))


def best_of_month(media: DataFrame, n: int, org: str = "org", id: str = "id", at: str = "taken_at", favourite: str = "is_favorite") -> DataFrame:
    """org, month, rank, id: favourites first, then the newest, at most n of each month."""
    month = F.date_format(at, "yyyy-MM")
    w = W.partitionBy(org, "month").orderBy(F.desc(F.coalesce(favourite, F.lit(False))), F.desc(at), id)
    return media.where(F.col(at).isNotNull()).withColumn("month", month).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(org, "month", "rank", id)


def _sessions(gap: int):
    """Runs of sorted rows (who, at in microseconds, n) within a task: who, start, end, n, and whether it is the task's first or last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        first, task = True, None

        def out(rows: list[list], last: bool) -> pa.RecordBatch:
            nonlocal first
            edges = [last] * len(rows)
            if rows and first:
                edges[0], first = True, False
            columns = [pa.array([task] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)), pa.array(edges, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["task", "who", "start", "end", "n", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py()
            who, at, n = batch.column("who"), batch.column("at").to_numpy(), batch.column("n").to_numpy()
            code = who.dictionary_encode().indices.fill_null(-1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(at) >= gap)) + 1])
            ends = np.append(starts[1:], len(at)) - 1
            rows = [list(r) for r in zip(who.take(pa.array(starts)).to_pylist(), at[starts].tolist(), at[ends].tolist(), np.add.reduceat(n, starts).tolist(), strict=True)]
            if open_ is not None:
                if open_[0] == rows[0][0] and rows[0][1] - open_[2] < gap:
                    rows[0][1], rows[0][3] = open_[1], open_[3] + rows[0][3]
                else:
                    rows.insert(0, open_)
            open_ = rows.pop()
            yield out(rows, False)
        if open_ is not None:
            yield out([open_], True)

    return run


def trips(media: DataFrame, gap: str, least: int, org: str = "org", at: str = "taken_at") -> DataFrame:
    """org, start, end, n: runs of photos with no gap of `gap` or longer, of at least `least` photos.

    Rows are counted by time, sorted by range and cut where they lie, so an org of any size is shared by all tasks. Only the first
    and the last run of a task can go on in another: these few, two for each task, are joined on the driver.
    """
    spark = media.sparkSession
    micros = spark.range(1).select(F.expr(f"unix_micros(TIMESTAMP '2000-01-01 00:00:00' + INTERVAL {gap}) - unix_micros(TIMESTAMP '2000-01-01 00:00:00')")).first()[0]
    kind = media.schema[org].dataType.simpleString()
    rows = media.where(F.col(at).isNotNull()).groupBy(F.col(org).cast("string").alias("who"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).agg(F.count("*").alias("n"))
    rows = rows.repartitionByRange("who", "at").sortWithinPartitions("who", "at").withColumn("task", F.spark_partition_id())
    found = materialise(rows.mapInArrow(_sessions(micros), "task int, who string, start long, end long, n long, edge boolean"))
    joined: list[list] = []
    for r in sorted(found.where("edge").collect(), key=lambda r: (r.task, r.who is not None, r.who or "", r.start)):
        if joined and joined[-1][0] == r.who and r.start - joined[-1][2] < micros:
            joined[-1][2], joined[-1][3] = r.end, joined[-1][3] + r.n
        else:
            joined.append([r.who, r.start, r.end, r.n])
    whole = spark.createDataFrame([tuple(r) for r in joined], "who string, start long, end long, n long")
    out = found.where("NOT edge").select("who", "start", "end", "n").union(whole).where(F.col("n") >= least)
    return out.select(F.col("who").cast(kind).alias(org), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")
