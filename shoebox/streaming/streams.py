"""Structured Streaming forms of ingest, change detection, job batches and running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import enrich, jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_jobs(rows: DataFrame, now: str, ocr: bool = True) -> DataFrame:
    """New media rows (a stream or a table) to their first jobs."""
    return jobs.initial_jobs(enrich.ingest_defaults(rows, now), ocr).withColumn("status", F.lit("pending"))


class LastValue(StatefulProcessor):
    """Emits a row whose value differs from the one before of its key; the first of a key counts as different."""

    def __init__(self, order: str, value: str, value_type: str):
        self.order, self.value, self.value_type = order, value, value_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", f"value {self.value_type}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        seen = self.state.exists()
        last = self.state.get()[0] if seen else None
        keep = []
        for value in frame[self.value].tolist():
            keep.append(not seen or value != last)
            seen, last = True, value
        self.state.update((last,))
        yield frame[keep]

    def close(self) -> None:
        pass


def changed_values(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The stream's rows whose value changed. Needs the RocksDB state store (ROCKSDB)."""
    return rows.groupBy(key).transformWithStateInPandas(LastValue(order, value, rows.schema[value].dataType.simpleString()), rows.schema, "append", "none")


def live_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in all that has arrived and stops; results in Parquet at path."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_batches(stream: DataFrame, now: str, size: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes, for every micro-batch of jobs, its due jobs grouped by type."""
    return each_batch(stream, lambda batch, _: jobs.by_type(jobs.due_batch(batch, now, size)).write.mode("append").parquet(path), checkpoint)
