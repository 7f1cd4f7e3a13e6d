"""A kept vector index: inverted lists of product-quantised vectors in the shared folder, with upserts and deletes.

    index = VectorIndex(spark, path)
    index.upsert(rows)            # the first rows fit the lists and the codebooks
    index.delete(ids)
    index.tune(k=10)              # measures how many lists and rows a search needs
    index.search(queries, k=10)   # query, id, score, rank
    index.compact()

Every change is a version: rows partitioned by list, and the (list, id) of the earlier rows that it replaces or deletes. A
version counts once the log names it. A search reads the codes of the lists it probes, adds up distances from tables of one
row for each query, and reads the vectors of the few best rows only, which it compares in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rounds import materialise
from .vectors import _matrix, _unit, fit_lists, knn

#: Entries of a subspace, codes of a codebook, vectors that fit codebooks.
WIDTH, CODES, SAMPLE = 4, 256, 20_000
#: Queries and rows of a bin of lists that meet in a task; rows scored at a time; pairs of a query and a list sent at a time.
ASKED, HELD, SLICE, SENT = 1024, 1 << 16, 4096, 1 << 15
#: Queries of the measurement, the shares of true neighbours that the probed lists and the compared rows must hold.
MEASURED, GOAL = 200, 0.985


def _padded(m: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces of WIDTH entries."""
    short = -m.shape[1] % WIDTH
    return np.pad(m, ((0, 0), (0, short))).reshape(len(m), -1, WIDTH)


def _lloyd(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """k-means in one subspace over a bounded sample."""
    r = np.random.default_rng(len(points))
    centres = points[r.choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None] - 2 * points @ centres.T, axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, k], len(centres)) for k in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.concatenate([centres, np.repeat(centres[:1], codes - len(centres), axis=0)])


def _codes(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest code of each subspace."""
    out = np.empty(residuals.shape[:2], np.uint8)
    for s, book in enumerate(books):
        out[:, s] = np.argmin((book**2).sum(1)[None] - 2 * residuals[:, s] @ book.T, axis=1)
    return out


class VectorIndex:
    """id: of any type that can be joined on. Vectors of another length than the first ones fitted are left out, as are null,
    empty and null-holding ones; to upsert one deletes its id. Of rows with one id in a batch, the greatest vector counts."""

    def __init__(self, spark: SparkSession, path: str, id: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.id, self.vector = spark, path.rstrip("/"), id, vector

    # The log, and what it names.

    def _log(self) -> list:
        """The versions since the last compaction, oldest first: version, base, rows, dead, probes, compared, kind."""
        from pyspark.errors import AnalysisException

        try:
            log = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/log")
        except AnalysisException:
            return []
        base = log.where("base").agg(F.max("version")).first()[0]
        return log.where(F.col("version") >= (base or 0)).orderBy("version").collect()

    def _commit(self, version: int, base: bool, rows: int, dead: int, probes: int, compared: int, kind: str) -> None:
        """Two writers of one version collide here, and one of them fails without a trace in later reads."""
        row = self.spark.createDataFrame([(version, base, rows, dead, probes, compared, kind)], "version long, base boolean, rows long, dead long, probes int, compared int, kind string")
        row.coalesce(1).write.parquet(f"{self.path}/log/{version:012d}")

    def _read(self, what: str, log: list) -> DataFrame | None:
        found = [f"{self.path}/{what}/version={r.version}" for r in log if r[what]]
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*found) if found else None

    def _fit(self):
        row = self.spark.read.parquet(f"{self.path}/fit").first()
        return np.array(row.centres, np.float64), np.array(row.books, np.float32)

    def live(self, *columns: str, lists: list[int] | None = None, log: list | None = None) -> DataFrame | None:
        """The rows that count (id, list, version and the columns asked for), of all lists or some; None if there are none."""
        log = self._log() if log is None else log
        rows, dead = self._read("rows", log), self._read("dead", log)
        if rows is None:
            return None
        rows = rows.select("id", "list", "version", *columns)
        if lists is not None:
            rows = rows.where(F.col("list").isin(lists))
            dead = dead.where(F.col("list").isin(lists)) if dead is not None else None
        if dead is None:
            return rows
        gone = dead.groupBy(F.col("id").alias("gone"), F.col("list").alias("of")).agg(F.max("version").alias("until"))
        return rows.join(gone, (rows["id"] == gone["gone"]) & (rows["list"] == gone["of"]) & (rows["version"] < gone["until"]), "left_anti")

    def rows(self) -> DataFrame | None:
        """id, vector of every row in the index."""
        found = self.live("vector")
        return None if found is None else found.select("id", "vector")

    # Fitting and changes.

    def _usable(self, df: DataFrame) -> DataFrame:
        v = F.col(self.vector).cast("array<double>")
        fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(self.id).alias("id"), F.when(fine, v).alias("vector")).where("id IS NOT NULL")

    def fit(self, rows: DataFrame, lists: int | None = None) -> None:
        """Lists (about the square root of the rows) and codebooks of the residuals, from rows (id, vector) of the most frequent length.

        Lists are fitted as by fit_lists(); codebooks on the SAMPLE rows of least hash,
        each subspace in a task of its own.
        """
        n, dim = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).select("count", "dim").first()
        rows = rows.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0))
        lists = lists or max(1, int(n**0.5))
        keyed = rows.select(F.xxhash64("id").alias("vec_id"), F.col("vector").alias("embedding"))
        centres = fit_lists(keyed, lists) if lists > 1 and not keyed.limit(2).count() < 2 else np.zeros((1, dim))
        sample = keyed.orderBy("vec_id").limit(SAMPLE)

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _unit(_matrix(batch.column("embedding")))
                    cut = _padded(m - centres[np.argmax(m @ centres.T, axis=1)]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(cut.shape[1]), len(cut)), pa.int32()), pa.array([x.tobytes() for row in cut for x in row], pa.binary())], ["sub", "part"])

        def book(table: pa.Table) -> pa.Table:
            points = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float32).reshape(-1, WIDTH)
            return pa.table({"sub": pa.array([table.column("sub")[0].as_py()], pa.int32()), "book": pa.array([_lloyd(points, CODES).tolist()], pa.list_(pa.list_(pa.float32())))})

        books = sample.mapInArrow(residuals, "sub int, part binary").groupBy("sub").applyInArrow(book, "sub int, book array<array<float>>").orderBy("sub").collect()
        books = [b.book for b in books] or [[[0.0] * WIDTH] * CODES] * -(-dim // WIDTH)
        self.spark.createDataFrame([(dim, centres.tolist(), books)], "dim int, centres array<array<double>>, books array<array<array<float>>>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fit")

    def _place(self, rows: DataFrame) -> DataFrame:
        """id, vector, code, list: the nearest list, and the codes of what is left of the unit vector there."""
        centres, books = self._fit()
        sent = self.spark.sparkContext.broadcast((centres, books))  # as large as the lists' centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = sent.value
            for batch in batches:
                m = _unit(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, centres.shape[1]))
                own = np.argmax(m @ centres.T, axis=1)
                codes = _codes(_padded(m - centres[own]).astype(np.float32), books)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own, pa.int32())], ["id", "vector", "code", "list"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.where(F.size("vector") == centres.shape[1]).mapInArrow(run, f"id {kind}, vector array<double>, code binary, list int")

    def _write(self, rows: DataFrame, what: str, version: int) -> int:
        """A version that the log does not name yet may be written again; lists of many rows become several files."""
        path = f"{self.path}/{what}/version={version}"
        rows.hint("rebalance", "list").write.partitionBy("list").mode("overwrite").parquet(path)
        try:
            return self.spark.read.parquet(path).count()
        except Exception as e:  # nothing was written, so there is no schema
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return 0

    def _change(self, ids: DataFrame, placed: DataFrame | None, log: list) -> None:
        version = log[-1].version + 1 if log else 1
        held, dead = self.live(log=log), 0
        if held is not None:
            dead = self._write(held.join(ids, "id", "left_semi").select("id", "list"), "dead", version)
        rows = self._write(placed, "rows", version) if placed is not None else 0
        self._commit(version, False, rows, dead, log[-1].probes if log else 0, log[-1].compared if log else 0, "upsert" if placed is not None else "delete")

    def upsert(self, df: DataFrame) -> None:
        """Adds the rows of df (id, vector) and replaces those of equal ids. The first rows fit the index."""
        log = self._log()
        batch = materialise(self._usable(df).groupBy("id").agg(F.max("vector").alias("vector")))
        usable = batch.where("vector IS NOT NULL")
        if not any(r.rows for r in log):
            if usable.isEmpty():
                return
            self.fit(usable)
        self._change(batch.select("id"), self._place(usable), log)

    def delete(self, ids: DataFrame) -> None:
        """Deletes the rows whose id is in ids; others are ignored."""
        log = self._log()
        if log:
            self._change(ids.select(F.col(self.id).alias("id")).distinct(), None, log)

    def compact(self) -> None:
        """One version that holds the live rows, so that later reads meet no replaced ones; search results stay the same."""
        log = self._log()
        rows = self.live("vector", "code", log=log)
        if rows is not None:
            version = log[-1].version + 1
            n = self._write(rows.drop("version"), "rows", version)
            self._commit(version, True, n, 0, log[-1].probes, log[-1].compared, "compact")

    # Search.

    def _scored(self, queries: DataFrame, probes: int, most: int, log: list) -> DataFrame:
        """query, nth, id, list, version, near, place: the `most` best rows of each query by codes, from its nearest lists.

        Lists meet their queries in bins of about HELD rows, and a bin returns `most` rows a query at most, without vectors.
        """
        centres, books = self._fit()
        sent = self.spark.sparkContext.broadcast((centres, books))
        dim, probes = centres.shape[1], min(probes, len(centres))
        kind = queries.schema["id"].dataType.simpleString()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value[0]
            for batch in batches:
                m = _unit(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, dim))
                each = max(1, SENT // probes)
                for start in range(0, len(m), each):
                    cut = m[start : start + each]
                    order = np.argsort(-(cut @ centres.T), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(len(cut)), order.shape[1])
                    unit = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * dim + 1, dim, dtype=np.int32)), pa.array(cut[at].ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(cut)).take(pa.array(at)), unit, pa.array(np.tile(np.arange(order.shape[1]), len(cut)), pa.int32()), pa.array(order.ravel(), pa.int32())], ["query", "asked", "nth", "list"])

        asked = materialise(queries.where(F.size("vector") == dim).mapInArrow(nearest, f"query {kind}, asked array<double>, nth int, list int"))
        lists = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most as many as there are lists
        rows = self.live("code", lists=lists, log=log)
        bins = max(2 * self.spark.sparkContext.defaultParallelism, -(-sum(r.rows for r in log) // HELD))
        bin_ = F.pmod(F.xxhash64("list"), F.lit(bins)).cast("int").alias("bin")
        asked, rows = asked.select("*", bin_), rows.select("*", bin_)
        held = rows.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(HELD)).cast("int").alias("r"))
        sizes = asked.groupBy("bin").agg(F.ceil(F.count_distinct("query") / F.lit(ASKED)).cast("int").alias("q")).join(held, "bin")
        sizes = F.broadcast(sizes)  # a row for each bin
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = rows.schema["id"].dataType.simpleString()
        left = asked.join(sizes, "bin").withColumns({"q": part("query", "q"), "r": each("r")}).select("bin", "q", "r", "list", "query", "asked", "nth", F.lit(None).cast(own).alias("id"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("binary").alias("code"))
        right = rows.join(sizes, "bin").withColumns({"r": part("id", "r"), "q": each("q")}).select("bin", "q", "r", "list", F.lit(None).cast(kind).alias("query"), F.lit(None).cast("array<double>").alias("asked"), F.lit(None).cast("int").alias("nth"), "id", F.col("version").cast("int").alias("version"), "code")

        def score(table: pa.Table) -> pa.Table:
            """The `most` best rows of each query among those of its lists in one bin."""
            centres, books = sent.value
            some = table.column("code").is_valid().to_numpy()
            q, r = table.filter(pa.array(~some)), table.filter(pa.array(some))
            names = q.column("query").combine_chunks().dictionary_encode()
            who, n = names.indices.to_numpy(), len(names.dictionary)
            best, places, nths = np.full((n, most), -np.inf, np.float32), np.zeros((n, most), np.int64), np.zeros((n, most), np.int32)
            if q.num_rows and r.num_rows:
                m = _matrix(q.column("asked").combine_chunks())[np.unique(who, return_index=True)[1]]
                tables = np.einsum("qsd,scd->qsc", _padded(m).astype(np.float32), books)
                codes = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint8).reshape(r.num_rows, -1)
                lists, nth, of = q.column("list").to_numpy(), q.column("nth").to_numpy(), r.column("list").to_numpy()
                order = np.argsort(of, kind="stable")
                for k in np.unique(lists).tolist():
                    mine = np.flatnonzero(lists == k)
                    asks, near_k = who[mine], (m[who[mine]] @ centres[k]).astype(np.float32)[:, None]
                    start, stop = np.searchsorted(of[order], [k, k + 1])
                    for at in range(start, stop, SLICE):
                        cut = order[at : min(at + SLICE, stop)]
                        found = np.repeat(near_k, len(cut), axis=1)
                        for s in range(codes.shape[1]):
                            found += tables[asks, s][:, codes[cut, s]]
                        near = np.concatenate([best[asks], found], axis=1)
                        place = np.concatenate([places[asks], np.broadcast_to(cut, found.shape)], axis=1)
                        list_of = np.concatenate([nths[asks], np.broadcast_to(nth[mine].astype(np.int32)[:, None], found.shape)], axis=1)
                        top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                        best[asks], places[asks], nths[asks] = (np.take_along_axis(x, top, 1) for x in (near, place, list_of))
            x, y = np.nonzero(best > -np.inf)
            at = pa.array(places[x, y])
            return pa.table({"query": names.dictionary.take(pa.array(x)), "nth": pa.array(nths[x, y]), **{c: r.column(c).take(at) for c in ("id", "list", "version")}, "near": pa.array(best[x, y].astype(np.float64))})

        out = left.union(right).groupBy("bin", "q", "r").applyInArrow(score, f"query {kind}, nth int, id {own}, list int, version int, near double")
        return out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "id"))).where(F.col("place") <= most)

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, compared: int | None = None) -> DataFrame:
        """query, id, score, rank: about the k rows of greatest cosine similarity, ties by id.

        queries have the index's id and vector columns and distinct ids. A query probes `probes` lists and compares `compared` rows in full; without a
        number it takes what tune() measured, else every list and 16 k rows. An empty index finds nothing.
        """
        log = self._log()
        asked = self._usable(queries).where("vector IS NOT NULL")
        kind = asked.schema["id"].dataType.simpleString()
        if self.live(log=log) is None:
            return self.spark.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")
        probes, compared = probes or log[-1].probes or 1 << 30, max(k, compared or log[-1].compared or 16 * k)
        found = self._scored(asked, probes, compared, log).select("query", "id", "list", "version")
        rows = self._read("rows", log)
        lists = sorted(r[0] for r in found.select("list").distinct().collect()) if len(self._fit()[0]) <= 1 << 14 else None
        rows = rows.where(F.col("list").isin(lists)) if lists is not None else rows
        met = found.join(rows.select("id", "list", F.col("version").cast("int").alias("version"), "vector"), ["id", "list", "version"])
        met = met.join(asked.select(F.col("id").alias("query"), F.col("vector").alias("asked")), "query")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = np.einsum("ij,ij->i", _unit(_matrix(batch.column("asked"))), _unit(_matrix(batch.column("vector")))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(scores)], ["query", "id", "score"])

        own = rows.schema["id"].dataType.simpleString()
        scored = met.select("query", "id", "asked", "vector").mapInArrow(exact, f"query {kind}, id {own}, score double")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def tune(self, k: int = 10, goal: float = GOAL, measured: int = MEASURED) -> tuple[int, int]:
        """Sets and returns the fewest lists and compared rows that each hold `goal` of the k nearest neighbours of some rows.

        The rows are those of least hash, `measured` of them. Their neighbours are found exactly among all rows, and by codes
        in all lists with up to a quarter of the rows in order, so the numbers hold for the whole index and not for a sample of it.
        """
        log = self._log()
        rows = self.live("vector", log=log)
        if rows is None:
            return 0, 0
        rows = materialise(rows)
        n = rows.count()
        asked = materialise(rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(measured).select("id", "vector"))
        keyed = lambda df: df.select(F.xxhash64("id").alias("vec_id"), F.col("vector").alias("embedding"))
        exact = knn(keyed(asked), keyed(rows), k).select(F.col("query").alias("q"), F.col("id").alias("x"))
        most = max(k, min(n, max(n // 4, 1), 200 * k))
        held = self._scored(asked, 1 << 30, most, log).select(F.xxhash64("query").alias("q"), F.xxhash64("id").alias("x"), "nth", "place")
        found = exact.join(held, ["q", "x"], "left").select("nth", "place").collect()  # measured * k rows
        lists = len(self._fit()[0])
        at = lambda values, last: sorted(values)[min(len(values), int(np.ceil(goal * len(values)))) - 1] if values else last
        probes = min(lists, at([r.nth + 1 if r.nth is not None else lists for r in found], lists))
        compared = max(k, at([r.place if r.place is not None else most for r in found], most))
        self._commit(log[-1].version + 1, False, 0, 0, probes, compared, "tune")
        return probes, compared
