"""Vector search: exact top-k, threshold links, centroids, inverted-file search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rounds import materialise

#: Queries that a task holds at a time; so many bytes of them, counted first, may go to the tasks with the code.
QUERY_BLOCK, QUERY_BYTES = 4096, 32 << 20
#: Rows of the corpus that meet a block of queries in a task, where queries are too many to be sent; rows and queries scored at a time.
CORPUS_BLOCK, SLICE, ASKED = 1 << 16, 2048, 256
#: Pivots of a threshold join at most, which the driver and each task hold, and from how many times as many rows they are chosen.
PIVOTS, FROM = 1024, 16
#: Rows of a tile of a threshold join, bytes of a block's doubles, blocks at least; angles that a task holds at a time; partitions
#: that pairs of blocks are dealt to at most.
TILE, BLOCK_BYTES, BLOCKS, ANGLES, PARTITIONS = 2048, 32 << 20, 8, 1 << 20, 4096
#: Rows that meet a tile at a time in single precision; numbers of vectors that are compared in doubles at a time.
OFFERED, EXACT = 512, 1 << 22
_KNN = "query long, id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero, so its similarity to anything is 0."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """id, vector without null, empty or null-holding vectors."""
    return df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))


class Best:
    """The k best rows of each query so far: greatest similarity, ties by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = _unit(queries), k
        self.ids, self.scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))

    def see(self, ids: np.ndarray, vectors: pa.Array) -> None:
        same = vectors.value_lengths().to_numpy(zero_copy_only=False) == self.queries.shape[1]
        ids, m = ids[same], _unit(_matrix(vectors.filter(pa.array(same)))) if same.any() else np.zeros((0, self.queries.shape[1]))
        for at in range(0, len(ids), SLICE):
            cut = m[at : at + SLICE]
            found = [self._merged(slice(q, q + ASKED), ids[at : at + SLICE], cut) for q in range(0, len(self.queries), ASKED)]
            self.ids, self.scores = (np.concatenate(x) for x in zip(*found, strict=True))

    def _merged(self, some: slice, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of some queries after they have seen the rows of m."""
        scores = np.concatenate([self.scores[some], self.queries[some] @ m.T], axis=1)
        own = np.concatenate([self.ids[some], np.broadcast_to(ids, (len(scores), len(m)))], axis=1)
        rounded = np.round(scores, 12)
        if scores.shape[1] > 4 * self.k:  # only those from the k-th best on, ties included, need sorting
            limit = np.partition(rounded, scores.shape[1] - self.k, axis=1)[:, [scores.shape[1] - self.k]]
            row, column = np.nonzero(rounded >= limit)
            n = np.bincount(row, minlength=len(scores))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            wide = int(n.max(initial=0))
            keep = np.full((2, len(scores), wide), np.inf)
            keep[0, row, place], keep[1, row, place] = -rounded[row, column], scores[row, column]
            left = np.zeros((len(scores), wide), np.int64)
            left[row, place] = own[row, column]
            own, scores, rounded = left, keep[1], -keep[0]
        order = np.lexsort((own, -rounded), axis=1)[:, : self.k]
        return np.take_along_axis(own, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self, query_ids: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.repeat(query_ids, self.ids.shape[1])), pa.array(self.ids.ravel()), pa.array(self.scores.ravel())]


def _top(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        for batch in batches:
            best.see(batch.column("id").to_numpy(), batch.column("vector"))
        yield pa.RecordBatch.from_arrays(best.rows(query_ids), ["query", "id", "score"])

    return run


def _met(k: int):
    """Top k of a block of queries over a block of the corpus; queries of each dimension on their own."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]]
        if left.num_rows and right.num_rows:
            ids, asked = left.column("id").to_numpy(), left.column("vector").combine_chunks()
            lengths = asked.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = lengths == d
                best = Best(_matrix(asked.filter(pa.array(own))), k)
                best.see(right.column("id").to_numpy(), right.column("vector").combine_chunks())
                found.append(best.rows(ids[own]))
        return pa.table({c: pa.concat_arrays([f[n] for f in found]) for n, c in enumerate(("query", "id", "score"))})

    return match


def knn(queries: DataFrame, corpus: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", min_score: float | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, id, score, rank: for each query the k rows of corpus of greatest cosine similarity, ties by id.

    Up to QUERY_BLOCK queries of one dimension and query_bytes bytes (both are counted first) go to the tasks, each of which
    keeps k rows a query, and no corpus row moves. More queries and the corpus are dealt to blocks, which meet in tasks: the
    corpus moves once for each QUERY_BLOCK queries. k of 0 or less means 20. Vectors of another dimension are skipped.
    """
    k = k if k > 0 else 20
    corpus, wanted = usable(corpus, id, vector), usable(queries, id, vector)
    n, short, long = wanted.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n:
        return queries.sparkSession.createDataFrame([], f"{_KNN}, rank int")
    if n <= QUERY_BLOCK and short == long and 8 * n * long <= query_bytes:
        own = wanted.collect()
        out = corpus.mapInArrow(_top(np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64), k), _KNN)
    else:
        parts = -(-n // QUERY_BLOCK), max(1, -(-corpus.count() // CORPUS_BLOCK))
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        dealt = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        left = wanted.withColumn("q", dealt(parts[0])).withColumn("c", each(parts[1]))
        right = corpus.withColumn("c", dealt(parts[1])).withColumn("q", each(parts[0]))
        out = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_met(k), _KNN)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """id, vector, copies: equal vectors once, under their least id."""
    return rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _block_rows(reps: DataFrame, block_rows: int | None = None) -> tuple[int, int]:
    """Rows of a block (if not given): BLOCK_BYTES of them as doubles, or fewer, so that there are about BLOCKS blocks; and pairs of such blocks.

    A row is sent once for each block it meets, so that what moves is BLOCKS times the table until blocks are full.
    """
    n, dim = reps.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = block_rows or max(TILE, min(BLOCK_BYTES // (8 * max(dim or 1, 1)), -(-n // BLOCKS)))
    blocks = max(1, -(-n // rows))
    return rows, blocks * (blocks + 1) // 2


def _pivots(reps: DataFrame, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most PIVOTS unit vectors of the most frequent length, one for each half block (or tile) of rows, and each one's group.

    They are chosen from FROM times as many rows, those of least hash: each is the one farthest from all before it. Groups,
    of about a block of rows where blocks are larger than tiles, are around the first of them.
    """
    rows = reps.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not sizes:
        return np.zeros((0, 0)), np.zeros(0, np.int32)
    n = min(PIVOTS, -(-2 * sizes["count"] // min(block_rows, TILE)))
    found = rows.where(F.size("vector") == sizes["dim"]).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(FROM * n).select("vector").collect()
    m = _unit(np.array([r[0] for r in found], float))
    chosen, best = [0], m @ m[0]
    while len(chosen) < min(n, len(m)):
        chosen.append(int(best.argmin()))
        np.maximum(best, m @ m[chosen[-1]], out=best)
    groups = len(chosen) if block_rows <= TILE else min(len(chosen), -(-sizes["count"] // block_rows))
    return m[chosen], (m[chosen] @ m[chosen[:groups]].T).argmax(1).astype(np.int32)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1, 1))


def _blocks(reps: DataFrame, block_rows: int | None, scope: str | None, extra: tuple[str, ...] = (), tau: float = 2.0) -> DataFrame:
    """scope, id, vector, extra columns, pivot, own, i, j: each row once for each pair (i, j) of blocks of its scope that its own is in and where it can have a partner.

    Rows belong to the nearest of some pivots, and pivots to groups. Vectors at distance below tau are less than theta apart, so a row
    meets the rows of another pivot only if it is within theta and their greatest angle of that pivot: blocks that are far from each
    other never meet. Groups of more than block_rows rows in a scope have several blocks. A tau above 1 (zero vectors then have
    partners) and vectors of several lengths leave one pivot, so that all blocks meet.
    """
    reps = reps.select("id", "vector", *extra, (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"))
    block_rows, pairs = _block_rows(reps, block_rows)
    pivots, groups = _pivots(reps, block_rows) if tau <= 1 else (np.zeros((0, 0)), np.zeros(0, np.int32))
    one_length = len(pivots) > 1 and reps.where(F.size("vector") != pivots.shape[1]).isEmpty()
    if one_length:
        theta = float(np.arccos(1 - tau)) + 1e-6
        each = max(1, ANGLES // len(pivots))
        of_group = (groups[:, None] == np.arange(groups.max() + 1)[None]).astype(np.float32)

        def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                for k in range(0, batch.num_rows, each):
                    cut = batch.slice(k, each)
                    yield cut, _angles(_unit(_matrix(cut.column("vector"))), pivots)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cut, angles in cuts(batches):
                at = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(at, pa.int32()), pa.array(groups[at], pa.int32()), pa.array(angles.min(1), pa.float64())], [*cut.schema.names, "pivot", "group", "angle"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema.fields)
        reps = materialise(reps.where(F.exists("vector", lambda x: x != 0)).mapInArrow(own, f"{kinds}, pivot int, group int, angle double"))
        radii = np.full(len(pivots), -np.inf)
        for pivot, radius in reps.groupBy("pivot").agg(F.max("angle")).collect():  # a number for each pivot
            radii[pivot] = radius

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cut, angles in cuts(batches):
                near = (angles <= radii[None] + theta).astype(np.float32) @ of_group > 0
                near[np.arange(len(near)), cut.column("group").to_numpy()] = True
                x, y = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(x)) for c in cut.columns), pa.array(y, pa.int32())], [*cut.schema.names, "met"])

        sent = reps.mapInArrow(reached, f"{kinds}, pivot int, group int, angle double, met int")
    else:
        reps = reps.withColumns({"pivot": F.lit(0), "group": F.lit(0)})
        sent = reps.withColumn("met", F.lit(0))
    sizes = reps.groupBy(F.col("scope").alias("of"), F.col("group").alias("at")).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    mine = sizes.select("of", F.col("at").alias("group_at"), F.col("blocks").alias("own_blocks"))
    sent = sent.join(sizes, F.col("scope").eqNullSafe(F.col("of")) & (F.col("met") == F.col("at"))).drop("of")
    sent = sent.join(mine, F.col("scope").eqNullSafe(F.col("of")) & (F.col("group") == F.col("group_at")))
    block = lambda group, part: F.shiftleft(group.cast("bigint"), 32) + part
    sent = sent.withColumn("own", block(F.col("group"), F.pmod(F.xxhash64("id"), "own_blocks")))
    sent = sent.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("other", block(F.col("met"), F.col("other")))
    sent = sent.select("scope", "id", "vector", *extra, "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # a number of partitions of its own: work follows pairs of blocks, and by their bytes several would be put in one task
    return sent.repartition(max(BLOCKS, min(PARTITIONS, 4 * pairs)), "scope", "i", "j")


def _tile_pairs(table: pa.Table, m: np.ndarray, tau: float, wanted=None, key: np.ndarray | None = None) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Whether a tile meets itself and the rows of two tiles, of all tiles of two blocks that can be near; m has the rows' unit vectors.

    Tiles are rows of one pivot, or a few. Those whose cones around their mean directions are more than tau apart are left
    out, as are those that are not wanted (a function of both tiles' rows). Where cones leave out less than half, rows are
    cut in the order of key, if there is one. Vectors that are not finite are near nothing.
    """
    i, j, own = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("own").to_numpy()
    finite = np.isfinite(m).all(1)

    def cut(by: np.ndarray, block: int) -> list[tuple[np.ndarray, tuple[np.ndarray, float]]]:
        rows = np.flatnonzero((own == block) & finite)
        rows = rows[np.argsort(by[rows], kind="stable")]
        return [(rows[k : k + TILE], _cone(m[rows[k : k + TILE]])) for k in range(0, len(rows), TILE)]

    for by in [table.column("pivot").to_numpy(), key]:
        left = cut(by, i)
        right = left if i == j else cut(by, j)
        near = np.array([[_reach(x, y, tau) for _, y in right] for _, x in left])
        if key is None or 2 * near.sum() < near.size:
            break
    for k, (a, _) in enumerate(left):
        for n, (b, _) in enumerate(right):
            if near[k, n] and not (i == j and n < k) and (wanted is None or wanted(a, b)):
                yield i == j and n == k, a, b


def _cone(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction of unit vectors and their greatest angle from it."""
    middle = _unit(m.mean(0, keepdims=True))[0]
    return middle, float(np.arccos(np.clip(m @ middle, -1, 1)).max()) if middle.any() else np.inf


def _reach(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float], tau: float) -> bool:
    """Whether vectors in two cones can be at distance below tau."""
    theta = float(np.arccos(1 - tau)) + 1e-6 if tau <= 1 else np.inf
    return not np.arccos(np.clip(a[0] @ b[0], -1, 1)) > a[1] + b[1] + theta


def _tiles(table: pa.Table, tau: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """_tile_pairs() with the distances between their rows, so a task holds one product of two tiles."""
    m = _unit(_matrix(table.column("vector").combine_chunks()))
    for itself, a, b in _tile_pairs(table, m, tau):
        yield itself, a, b, 1 - m[a] @ m[b].T


def _single(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors in single precision, and more than twice what their products may be off by."""
    return m.astype(np.float32), (m.shape[1] + 8) * 2.0**-23


def _distances(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of rows x of m from rows y, pair by pair."""
    each = max(1, EXACT // m.shape[1])
    parts = [1 - np.einsum("ij,ij->i", m[x[k : k + each]], m[y[k : k + each]]) for k in range(0, len(x), each)]
    return np.concatenate(parts) if parts else np.zeros(0)


def close_pairs(reps: DataFrame, tau: float, block_rows: int | None = None, scope: str | None = None) -> DataFrame:
    """a, b, distance with a < b for all pairs of rows (id, vector) at cosine distance below tau.

    Rows are dealt to blocks around pivots, and a task multiplies two blocks that the triangle bound does not part, tile by
    tile: exact, with work that is shared evenly and follows how many rows are near each other. With scope, only pairs of equal scope.
    """

    def multiply(table: pa.Table) -> pa.Table:
        ids, found = table.column("id").to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for itself, left, right, d in _tiles(table, tau):
            x, y = np.nonzero(d < tau)
            a, b, d = ids[left[x]], ids[right[y]], d[x, y]
            keep = a < b if itself else np.ones(len(a), bool)
            found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[keep]))
        return pa.table({c: np.concatenate(x) for c, x in zip(("a", "b", "distance"), zip(*found, strict=True), strict=True)})

    return _blocks(reps, block_rows, scope, (), tau).groupBy("scope", "i", "j").applyInArrow(multiply, "a long, b long, distance double")


def close_counts(reps: DataFrame, tau: float, block_rows: int | None = None) -> DataFrame:
    """id, linked: how many copies of other rows (id, vector, copies) are at cosine distance below tau, added up block by block."""

    def count(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy()
        linked = np.zeros(table.num_rows, np.int64)
        for itself, left, right, d in _tiles(table, tau):
            near = d < tau
            if itself:
                near &= left[:, None] != right[None, :]
            linked[left] += near @ copies[right]
            if not itself:
                linked[right] += copies[left] @ near
        return pa.table({"id": table.column("id"), "linked": linked})

    return _blocks(reps, block_rows, None, ("copies",), tau).groupBy("scope", "i", "j").applyInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def _floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.nan_to_num(table.column(c).cast(pa.float64()).to_numpy(), nan=np.inf) for c in names]


def _first_near(m: np.ndarray, single: np.ndarray, slack: float, rows: np.ndarray, others: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has another at distance below tau among `others`, and the place of the first."""
    s = single[rows] @ single[others].T
    s[rows[:, None] == others[None]] = -np.inf
    maybe = s > 1 - tau - slack
    first, k = maybe.argmax(1), np.arange(len(rows))
    some = maybe[k, first]
    for row in np.flatnonzero(some & ~(s[k, first] > 1 - tau + slack)):  # too close to tau for single precision
        at = np.flatnonzero(maybe[row])
        near = at[_distances(m, np.full(len(at), rows[row]), others[at]) < tau]
        some[row], first[row] = len(near) > 0, near[0] if len(near) else 0
    return some, first


def least_offers(reps: DataFrame, tau: float, block_rows: int | None = None, scope: str | None = None) -> DataFrame:
    """id, offer for rows (id, vector, asks: whether it does, low) that ask: the least `low` of the other rows at cosine distance below tau.

    Only rows that ask and rows that offer are multiplied, from the least offer on; a row that has found one asks no more.
    """

    def offer(table: pa.Table) -> pa.Table:
        i, j, own, pivot = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("own").to_numpy(), table.column("pivot").to_numpy()
        asks, (low,) = table.column("asks").to_numpy(), _floats(table, "low")
        m = _unit(_matrix(table.column("vector").combine_chunks()))
        single, slack = _single(m)
        finite, best = np.isfinite(m).all(1), np.full(table.num_rows, np.inf)
        for mine, other in [(i, j)] if i == j else [(i, j), (j, i)]:
            rows, others = np.flatnonzero((own == mine) & asks & finite), np.flatnonzero((own == other) & np.isfinite(low) & finite)
            rows, others = rows[np.argsort(pivot[rows], kind="stable")], others[np.lexsort((pivot[others], low[others]))]
            for at in range(0, len(others), OFFERED):
                some = others[at : at + OFFERED]
                cone = _cone(m[some])
                for k in range(0, len(rows), OFFERED):
                    cut = rows[k : k + OFFERED]
                    if _reach(_cone(m[cut]), cone, tau):
                        found, first = _first_near(m, single, slack, cut, some, tau)
                        best[cut[found]] = low[some[first[found]]]
                rows = rows[~np.isfinite(best[rows])]
                if not len(rows):
                    break
        some = np.isfinite(best)
        return pa.table({"id": table.column("id").filter(pa.array(some)), "offer": best[some].astype(np.int64)})

    reps = reps.where("asks OR low IS NOT NULL")
    found = _blocks(reps, block_rows, scope, ("asks", "low"), tau).groupBy("scope", "i", "j").applyInArrow(offer, "id long, offer long")
    return found.groupBy("id").agg(F.min("offer").alias("offer"))


def nearest_offers(reps: DataFrame, tau: float, block_rows: int | None = None, scope: str | None = None) -> DataFrame:
    """id, offer for rows (id, vector, asks, fixed, early): what the nearest row at cosine distance below tau offers.

    A row that asks (asks is a number) is offered another's `fixed`, or its `early` where that is less than what the row asks
    with; the lesser of both. Of equally near rows the least offer counts. A block task returns one row for each asking row.
    Tiles are multiplied in single precision; pairs that may be nearer than the nearest so far are compared in doubles.
    """

    def offer(table: pa.Table) -> pa.Table:
        asks, fixed, early = _floats(table, "asks", "fixed", "early")
        since = np.where(np.isfinite(fixed), -np.inf, early)  # a row offers to those that ask with more
        m = _unit(_matrix(table.column("vector").combine_chunks()))
        single, slack = _single(m)
        nearest, least, best = np.full(table.num_rows, np.inf), np.full(table.num_rows, np.inf), np.empty(table.num_rows, np.float32)

        def bound(rows: np.ndarray) -> np.ndarray:
            """The product that another row must exceed to be nearer than the nearest so far."""
            return np.where(np.isfinite(asks[rows]), 1 - np.minimum(nearest[rows], tau) - slack, np.inf).astype(np.float32)

        def look(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> None:
            """Rows x see rows y at products s: the greatest of each are compared in doubles."""
            may = since[y] < asks[x]
            x, y, s = x[may], y[may], s[may]
            best[x] = -np.inf
            np.maximum.at(best, x, s)
            may = s >= best[x] - 2 * slack
            x, y = x[may], y[may]
            d, offers = _distances(m, x, y), np.minimum(fixed[y], np.where(early[y] < asks[x], early[y], np.inf))
            order = np.lexsort((offers, d, x))
            order = order[d[order] < tau]
            order = order[np.unique(x[order], return_index=True)[1]]
            x, d, offers = x[order], d[order], offers[order]
            least[x] = np.where(d < nearest[x], offers, np.where(d == nearest[x], np.minimum(offers, least[x]), least[x]))
            nearest[x] = np.minimum(d, nearest[x])

        def asked(rows: np.ndarray, others: np.ndarray) -> bool:
            most = asks[rows]
            return bool((most[np.isfinite(most)] > since[others].min()).any())

        for itself, left, right in _tile_pairs(table, m, tau, None, since):
            for rows, others in [(left, right)] if itself else [(left, right), (right, left)]:
                for k in range(0, len(rows), OFFERED) if asked(rows, others) else ():
                    some = rows[k : k + OFFERED]
                    s = single[some] @ single[others].T
                    if itself:
                        s[np.arange(len(some)), np.arange(k, k + len(some))] = -np.inf
                    least_s = bound(some)
                    hit = np.flatnonzero(s.max(1) > least_s)
                    x, y = np.divmod(np.flatnonzero(s[hit] > least_s[hit, None]), len(others))
                    look(some[hit[x]], others[y], s[hit[x], y])
        some = np.isfinite(nearest)
        return pa.table({"id": table.column("id").filter(pa.array(some)), "distance": nearest[some], "offer": least[some].astype(np.int64)})

    extra = ("asks", "fixed", "early")
    reps = reps.where(" OR ".join(f"{c} IS NOT NULL" for c in extra))
    found = _blocks(reps, block_rows, scope, extra, tau).groupBy("scope", "i", "j").applyInArrow(offer, "id long, distance double, offer long")
    return found.groupBy("id").agg(F.min_by("offer", F.struct("distance", "offer")).alias("offer"))


def link_counts(df: DataFrame, tau: float, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, class_id, n_links: the vector's class of equal vectors, and how many other rows are at distance below tau.

    Only different vectors are compared; copies count through their class's size (a zero vector's copies are at distance 1
    and count only if tau is greater). No pair leaves its task.
    """
    rows = materialise(usable(df, id, vector))
    reps = materialise(distinct_vectors(rows))
    linked = close_counts(reps, tau)
    zero = ~F.exists("vector", lambda x: x != 0)
    inside = F.when(zero & F.lit(tau <= 1), F.lit(0)).otherwise(F.col("copies") - 1)
    per = reps.join(linked, "id", "left").select("vector", F.col("id").alias("class_id"), (inside + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return rows.join(per, "vector").select("id", "class_id", F.col("n_links").cast("long"))


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, n, centroid: the mean vector of each key, with map-side sums of positions, so no group is collected."""
    rows = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    means = rows.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


#: Vectors that an inverted file is fitted and measured on (those of least hash), queries of the measurement among them, and in
#: how many of its nearest lists each row stands.
SAMPLE, MEASURED, COPIES, PER_LIST = 20_000, 200, 3, 32


def _sample(df: DataFrame, id: str, vector: str, n: int) -> DataFrame:
    return usable(df, id, vector).orderBy(F.xxhash64("id"), "id").limit(n)


def fit_lists(df: DataFrame, lists: int, id: str = "vec_id", vector: str = "embedding", sample: int | None = None, seed: int = 1) -> np.ndarray:
    """Centres of an inverted file: spherical k-means on at most `sample` vectors that are not zero, those of least hash.

    Without a number the sample is SAMPLE vectors, or PER_LIST for each list where that is more.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = df.where(F.exists(vector, lambda x: x != 0))
    rows = materialise(_sample(some, id, vector, sample or max(SAMPLE, PER_LIST * lists)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows)
    return _unit(np.array(model.clusterCenters()))


def _nearest_lists(m: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(_unit(m) @ centres.T), axis=1, kind="stable")[:, :n]


def pick_probes(df: DataFrame, centres: np.ndarray, k: int, goal: float = 0.95, copies: int = COPIES, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> int:
    """The fewest probes at which MEASURED sampled vectors find `goal` of their exact top k among at most `sample` vectors.

    The driver holds that sample. In the whole table neighbours are closer than in a sample of it, so recall there is no lower.
    """
    rows = _sample(df, id, vector, sample).select("vector").collect()
    m = _unit(np.array([r[0] for r in rows], float))
    asked = m[:MEASURED]
    if not len(m):
        return 1
    top = np.argsort(-np.round(asked @ m.T, 12), axis=1, kind="stable")[:, :k]
    rank = np.argsort(_nearest_lists(asked, centres, len(centres)), axis=1)  # of each list, for each query
    own = _nearest_lists(m, centres, copies)
    needed = np.take_along_axis(rank, own[top].reshape(len(asked), -1), 1).reshape(*top.shape, -1).min(2)  # probes that reach a neighbour
    return int(np.sort(needed.ravel())[min(needed.size, int(np.ceil(goal * needed.size))) - 1]) + 1


def ivf_search(queries: DataFrame, corpus: DataFrame, centres: np.ndarray, probes: int, k: int = 20, id: str = "vec_id", vector: str = "embedding", copies: int = COPIES) -> DataFrame:
    """Approximate knn(): each row stands in its `copies` nearest lists, and meets the queries that probe one of them.

    Lists are salted. probes: see pick_probes.
    """
    lists = len(centres)

    def nearest(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = _nearest_lists(_matrix(batch.column("vector")), centres, n)
                at = np.repeat(np.arange(batch.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), batch.column("id").take(pa.array(at)), batch.column("vector").take(pa.array(at))], ["list", "id", "vector"])

        return run

    schema = f"list int, id long, vector {corpus.schema[vector].dataType.simpleString()}"
    rows = usable(corpus, id, vector).mapInArrow(nearest(min(copies, lists)), schema).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    asked = usable(queries, id, vector).mapInArrow(nearest(min(probes, lists)), schema).withColumn("salt", F.explode(F.expr("sequence(0L, 7L)")))
    found = asked.groupBy("list", "salt").cogroup(rows.groupBy("list", "salt")).applyInArrow(_met(k), _KNN)
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
