"""Substring search by an index of trigrams in the shared folder.

Every row's texts, in lower case, are cut into windows of three characters, and each distinct window is a row (gram, id),
sorted by range, so that a filter on a few grams reads the few row groups that hold them. A search takes the rarest windows
of what is asked, intersects their rows, and tests the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import matches_text

#: Windows of a query whose rows are intersected: the rarest ones. Texts cut at a time.
RAREST, ROWS = 12, 256


def grams_of(text: str) -> np.ndarray:
    """The distinct windows of three characters, each as one number (21 bits a character)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            found = [np.unique(np.concatenate([grams_of(t) for t in texts])) for texts in part.column(1).to_pylist()]
            n = np.array([len(g) for g in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], ["gram", "id"])


class TextIndex:
    """An index of the text columns of a table, kept at path. Null texts are empty; rows without an id are left out of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, id: str, *columns: str) -> TextIndex:
        texts = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
        kind = df.schema[id].dataType.simpleString()
        rows = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), texts.alias("texts")).mapInArrow(_cut, f"gram bigint, id {kind}")
        rows.repartitionByRange("gram", F.xxhash64("id")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/rows")
        counts = self.spark.read.parquet(f"{self.path}/rows").groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def candidates(self, query: str) -> DataFrame | None:
        """id of the rows that have the query's rarest windows; None for a query of less than three characters, which has no window."""
        grams = grams_of(query.strip().lower()).tolist()
        if not grams:
            return None
        counts = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).collect()  # a row for each window
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if len(counts) < len(grams):  # a window that no row has
            return rows.select("id").limit(0)
        rarest = [r.gram for r in sorted(counts, key=lambda r: (r.n, r.gram))[:RAREST]]
        found = rows.where(F.col("gram").isin(rarest))
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("id")

    def search(self, df: DataFrame, query: str, id: str, *columns: str) -> DataFrame:
        """The rows of df with an id that matches_text() finds. Queries of one or two characters scan the table."""
        found = self.candidates(query) if query.strip() else None
        met = matches_text(query, *columns)
        if found is None:
            return df.where(F.col(id).isNotNull() & met)
        return df.join(found.withColumnRenamed("id", "_found"), F.col(id) == F.col("_found"), "left_semi").where(met)
