"""Near-duplicate embeddings by NN-descent: neighbours of neighbours meet until the links of the graph are all found.

Every distinct vector has a list of its nearest neighbours so far. Lists begin in blocks between random hyperplanes; then
rounds let the neighbours of each vector, either way round, meet in a task, which returns the pairs that better a list. A list
holds NEAR vectors, and as many more as are links, up to MOST. After the rounds an audit compares a sample with all vectors;
as long as links are missing, further hyperplanes and rounds follow. Links are confirmed in double precision. Vectors whose
lists are full of links have theirs counted exactly: their angles to the middle of their component settle most pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rounds import components
from .common import materialise

log = logging.getLogger(__name__)

#: Neighbours in a list, links in a list, reverse neighbours that join a round, on average.
NEAR, MOST, REVERSE = 12, 64, 12
#: Vectors of a block between hyperplanes; times that blocks are cut before the rounds.
BLOCK, PASSES = 1024, 3
#: Sampled vectors of the audit, share of their links that must be in the lists, rounds at most.
AUDIT, GOAL, ROUNDS = 2048, 0.995, 24
#: Width in radians of the rings around the middle of a component; vectors that meet in a task there.
RING, MEET = 0.02, 2048
_EDGES = "a bigint, b bigint, sim float, fresh boolean"


def usable(vector: str) -> F.Column:
    """False for vectors that link with nothing: null, empty, zero, or with a null or non-finite entry."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    """Equally long list vectors as unit rows in doubles."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _codes(values: list[bytes]) -> np.ndarray:
    """Equally long codes (16 bits an entry) as unit rows."""
    m = np.frombuffer(b"".join(values), "<i2").astype(np.float32).reshape(len(values), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def slack(dimension: int) -> float:
    """By how much a cosine of codes can differ from the vectors' own: half a step of 1 / 32767 in each entry of both."""
    return 3.2e-5 * dimension**0.5 + 1e-5


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = []
        for v in batch.column("vector"):
            m = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            m = m / np.abs(m).max()
            codes.append(np.rint(32767 * m).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.binary())], ["node", "code"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of `rows` rows or more while there are as many."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column(key).to_numpy()
        cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            count -= cut
    if held:
        yield pa.Table.from_batches(held)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])


def _out(a, b, sim, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32()), pa.array(fresh, pa.bool_())], ["a", "b", "sim", "fresh"])


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, tau: float, near: int, most: int) -> pa.RecordBatch:
    """Of pairs, those that a list of a could still hold."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, sim = a[fresh], b[fresh], sim[fresh]
    starts = _starts(a) if len(a) else np.array([0])
    rank = np.arange(len(a)) - np.repeat(starts[:-1], np.diff(starts))
    keep = (rank < near) | ((sim >= tau) & (rank < most))
    return _out(a[keep], b[keep], sim[keep], np.ones(int(keep.sum()), bool))


def _planes(bits: int, seed: int):
    """The side of `bits` random hyperplanes on which each vector lies, as one number; vectors of each length on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = pc.binary_length(batch.column("code")).to_numpy() // 2
            sides = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(lengths).tolist():
                if d not in normals:
                    normals[d] = np.random.default_rng([seed, d]).normal(size=(d, bits)).astype(np.float32)
                own = np.flatnonzero(lengths == d)
                signs = _codes(batch.column("code").take(pa.array(own)).to_pylist()) @ normals[d] > 0
                sides[own] = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(lengths.astype(np.int32)), pa.array(sides)], ["node", "code", "dim", "side"])

    return run


def _within(tau: float, near: int, most: int):
    """The best pairs inside each block (column key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 1):
            starts = _starts(table.column("key").to_numpy())
            for s, e in zip(starts, starts[1:], strict=False):
                ids, m = table.column("node").to_numpy()[s:e], _codes(table.column("code").slice(s, e - s).to_pylist())
                if len(ids) < 2:
                    continue
                for at in range(0, len(m), 512):
                    sims = m[at : at + 512] @ m.T
                    sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
                    k = min(near, len(m) - 1)
                    limit = np.minimum(np.partition(sims, len(m) - k, axis=1)[:, len(m) - k], tau)
                    x, y = np.nonzero(sims >= limit[:, None])
                    keep = sims[x, y] > -1.5
                    yield _best(ids[at + x[keep]], ids[y[keep]], sims[x, y][keep], tau, near, most)

    return run


def seeded(nodes: DataFrame, total: int, seed: int, tau: float, near: int, most: int, block: int) -> DataFrame:
    """Edges between the nearest vectors of each block between hyperplanes. Blocks of too many vectors are dealt apart."""
    bits = min(62, max(0, (max(1, total) // block).bit_length()))
    rows = nodes.select("node", "code").mapInArrow(_planes(bits, seed), "node bigint, code binary, dim int, side bigint")
    counts = rows.groupBy("dim", "side").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))
    rows = rows.join(counts, ["dim", "side"]).select("node", "code", F.xxhash64("dim", "side", F.pmod(F.xxhash64("node", F.lit(seed)), "parts"), "dim").alias("key"), "dim")
    return rows.repartition("key").sortWithinPartitions("key", "dim").select("node", "code", "key").mapInArrow(_within(tau, near, most), _EDGES)


def merged(edges: DataFrame, tau: float, near: int, most: int) -> DataFrame:
    """a, b, sim, fresh, rank: each list again with its NEAR best and its links; what was there before is not fresh."""
    own = edges.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= most)
    return own.where((F.col("rank") <= near) | (F.col("sim") >= tau))


def _meeting(tau: float, near: int, most: int):
    """Pairs of neighbours of one vector (column w), at least one of them fresh, that better a list."""

    def pairs(w: np.ndarray, ids: np.ndarray, fresh: np.ndarray, limit: np.ndarray, m: np.ndarray):
        starts = _starts(w)
        sizes = np.diff(starts)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            wide = int(sizes[order[at]])
            stop = at
            while stop < len(order) and (stop - at + 1) * int(sizes[order[stop]]) ** 2 <= 1 << 20:
                wide = int(sizes[order[stop]])
                stop += 1
            stop = max(stop, at + 1)
            own = order[at:stop]
            at = stop
            if wide < 2:
                continue
            place = starts[own][:, None] + np.arange(wide)[None]
            there = np.arange(wide)[None] < sizes[own][:, None]
            place = np.where(there, place, 0)
            v = m[place]
            sims = np.matmul(v, v.transpose(0, 2, 1))
            some = there & fresh[place]
            ok = (some[:, :, None] | some[:, None, :]) & there[:, :, None] & there[:, None, :] & (sims > limit[place][:, :, None]) & (ids[place][:, :, None] != ids[place][:, None, :])
            g, x, y = np.nonzero(ok)
            yield ids[place[g, x]], ids[place[g, y]], sims[g, x, y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "w"):
            codes = table.column("code")
            lengths = pc.binary_length(codes).to_numpy()
            for d in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == d)
                w, ids, fresh, limit = (table.column(c).to_numpy()[some] for c in ("w", "member", "fresh", "limit"))
                order = np.lexsort((~fresh, ids, w))  # a neighbour both ways counts once
                w, ids, fresh, limit = w[order], ids[order], fresh[order], limit[order]
                once = np.ones(len(w), bool)
                once[1:] = (w[1:] != w[:-1]) | (ids[1:] != ids[:-1])
                m = _codes(codes.take(pa.array(some[order][once])).to_pylist())
                found = list(pairs(w[once], ids[once], fresh[once], limit[once], m))
                if found:
                    yield _best(*(np.concatenate(x) for x in zip(*found, strict=True)), tau, near, most)

    return run


def descended(nodes: DataFrame, edges: DataFrame, seed: int, tau: float, near: int, most: int, reverse: int) -> DataFrame:
    """One round: the neighbours of every vector meet. Of a vector that very many lists hold, `reverse` of them are drawn by hash.

    A list that is full of links takes no more: crowded_counts() counts them.
    """
    nth = lambda n: F.max(F.when(F.col("rank") == n, F.col("sim")))
    held = edges.groupBy("a").agg(F.count("*").alias("n"), nth(near).alias("near"), nth(most).alias("most"))
    limit = F.when(F.col("most") >= tau, 2.0).when(F.col("n") >= near, F.least("near", F.lit(tau).cast("float"))).otherwise(-2.0)
    state = nodes.select("node", "code").join(held.select(F.col("a").alias("node"), limit.cast("float").alias("limit")), "node", "left")
    popular = edges.groupBy("b").agg(F.count("*").alias("lists"))
    drawn = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 20)) * F.col("lists") < reverse << 20
    back = edges.join(popular, "b").where(drawn)
    met = edges.select(F.col("a").alias("w"), F.col("b").alias("member"), "fresh").union(back.select("b", "a", "fresh"))
    sent = met.join(state, F.col("member") == F.col("node")).select("w", "member", "fresh", F.coalesce("limit", F.lit(-2.0)).cast("float").alias("limit"), "code")
    found = sent.repartition("w").sortWithinPartitions("w").mapInArrow(_meeting(tau, near, most), _EDGES)
    return merged(edges.select("a", "b", "sim", F.lit(False).alias("fresh")).union(found), tau, near, most)


def audit(nodes: DataFrame, edges: DataFrame, tau: float, most: int, sample: int = AUDIT) -> float:
    """The share of the links of at most `sample` vectors (those of least hash) that their lists hold; full lists do not count."""
    rows = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(sample).select("node", "code").collect()
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(len(r.code), []).append(r)
    asked = {n: (np.array([r.node for r in g]), _codes([bytes(r.code) for r in g])) for n, g in groups.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            lengths = pc.binary_length(batch.column("code")).to_numpy()
            for n in np.unique(lengths).tolist():
                if n not in asked:
                    continue
                own = np.flatnonzero(lengths == n)
                ids, m = asked[n]
                near = _codes(batch.column("code").take(pa.array(own)).to_pylist()) @ m.T >= tau
                near &= batch.column("node").to_numpy()[own][:, None] != ids[None]
                for i, c in zip(ids.tolist(), near.sum(0).tolist(), strict=True):
                    total[i] = total.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["a", "n"])

    true = dict(nodes.select("node", "code").mapInArrow(count, "a bigint, n bigint").groupBy("a").agg(F.sum("n")).collect())
    chosen = nodes.sparkSession.createDataFrame([(r.node,) for r in rows], "a bigint")
    found = dict(edges.where(F.col("sim") >= tau).join(F.broadcast(chosen), "a").groupBy("a").count().collect())
    counted = [(found.get(a, 0), n) for a, n in true.items() if n and found.get(a, 0) < most]
    return sum(min(f, n) for f, n in counted) / sum(n for _, n in counted) if counted else 1.0


def neighbour_graph(nodes: DataFrame, total: int, tau: float, near: int = NEAR, most: int = MOST, reverse: int = REVERSE, block: int = BLOCK, passes: int = PASSES, goal: float = GOAL, rounds: int = ROUNDS) -> DataFrame:
    """a, b, sim, fresh, rank: the lists of the nodes (node, code) after rounds until an audit finds `goal` of the links."""
    edges = seeded(nodes, total, 0, tau, near, most, block)
    for seed in range(1, passes if total > block else 1):
        edges = edges.union(seeded(nodes, total, seed, tau, near, most, block))
    edges = materialise(merged(edges, tau, near, most).withColumn("fresh", F.lit(True)))
    for k in range(1, rounds + 1):
        edges = materialise(descended(nodes, edges, k, tau, near, most, reverse))
        new, links = edges.where("fresh").agg(F.count("*"), F.count(F.when(F.col("sim") >= tau, 1))).first()
        if links and new > 0.02 * near * total:
            continue
        recall = audit(nodes, edges, tau, most)
        if recall >= goal or k == rounds:
            log.log(logging.INFO if recall >= goal else logging.WARNING, "neighbour lists hold %.4f of the audited links after %d rounds", recall, k)
            break
        edges = materialise(merged(edges.drop("rank").union(seeded(nodes, total, 100 + k, tau, near, most, block)), tau, near, most))
    return edges


def _confirm(tau: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            lengths = batch.column("va").value_lengths().to_numpy()
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                x, y = (_vectors(batch.column(c).take(pa.array(own))) for c in ("va", "vb"))
                keep[own] = np.einsum("ij,ij->i", x, y) >= tau
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep))

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        comp = batch.column("comp").to_numpy()
        total: dict[int, np.ndarray] = {}
        if len(comp):
            order = np.argsort(comp, kind="stable")
            starts = _starts(comp[order])
            for s, e in zip(starts, starts[1:], strict=False):
                total[int(comp[order[s]])] = _vectors(batch.column("vector").take(pa.array(order[s:e]))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, v in total.items() for _ in v], pa.int64()), pa.array([k for v in total.values() for k in range(len(v))], pa.int32()), pa.array([float(x) for v in total.values() for x in v], pa.float64())], ["comp", "pos", "value"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = np.zeros(batch.num_rows)
        lengths = batch.column("vector").value_lengths().to_numpy()
        for d in np.unique(lengths):
            own = pa.array(np.flatnonzero(lengths == d))
            pivot = batch.column("pivot").take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            length = np.linalg.norm(pivot, axis=1, keepdims=True)
            pivot = np.divide(pivot, length, out=np.zeros_like(pivot), where=length > 0)
            angle[own.to_numpy()] = np.arccos(np.clip(np.einsum("ij,ij->i", _vectors(batch.column("vector").take(own)), pivot), -1, 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "node", "vector", "copies", "crowded")), pa.array(angle), pa.array(np.floor(angle / RING).astype(np.int32))], ["comp", "node", "vector", "copies", "crowded", "angle", "ring"])


def _counted(tau: float):
    """Links of the rows that ask with those that answer."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        left, right = table.filter(asks), table.filter(pc.invert(asks))
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            ids = left.column("node").to_numpy()
            near = _vectors(left.column("vector").combine_chunks()) @ _vectors(right.column("vector").combine_chunks()).T >= tau
            near &= ids[:, None] != right.column("node").to_numpy()[None]
            n = near @ right.column("copies").to_numpy()
        return pa.table({"node": pa.array(ids), "n": pa.array(n, pa.int64())})

    return run


def crowded_counts(members: DataFrame, tau: float, meet: int = MEET) -> DataFrame:
    """node, n_others: how many copies of other vectors are linked with each crowded member, exactly.

    members: comp, node, vector, copies, crowded, all of a component whose links stay inside it. Two vectors at angles x and
    y from their component's middle are at most x + y and at least |x - y| apart, which settles rings of angles against
    each other: as many copies as a ring holds, or none. Rings that stay open meet in tasks of `meet` by `meet` vectors.
    """
    theta = float(np.arccos(tau))
    sums = members.where("crowded").select("comp", "vector").mapInArrow(_sums, "comp bigint, pos int, value double").groupBy("comp", "pos").agg(F.sum("value").alias("value"))
    pivots = sums.groupBy("comp").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("pivot"))
    kind = members.schema["vector"].dataType.simpleString()
    rows = materialise(members.join(pivots, "comp").mapInArrow(_angles, f"comp bigint, node bigint, vector {kind}, copies bigint, crowded boolean, angle double, ring int"))
    rings = rows.groupBy("comp", "ring").agg(F.sum("copies").alias("copies"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / F.lit(meet)).cast("int").alias("parts"), F.max("crowded").alias("crowded"))
    other = rings.select("comp", F.col("ring").alias("ring2"), F.col("copies").alias("copies2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("parts").alias("parts2"))
    pairs = rings.where("crowded").join(other, "comp")  # at most (pi / RING) ** 2 a component
    sure = F.col("high") + F.col("high2") <= theta - 1e-7
    never = F.greatest(F.col("low") - F.col("high2"), F.col("low2") - F.col("high")) > theta + 1e-7
    settled = pairs.where(sure).groupBy("comp", "ring").agg(F.sum("copies2").alias("all"), F.max((F.col("ring") == F.col("ring2")).cast("int")).alias("itself"))
    crowd = rows.where("crowded")
    certain = crowd.join(settled, ["comp", "ring"]).select("node", (F.col("all") - F.col("copies") * F.col("itself")).alias("n"))
    still = materialise(pairs.where(~sure & ~never).select("comp", "ring", "ring2", "parts", "parts2"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["comp", "ring", "ring2", "p", "q"]
    left = crowd.join(still, ["comp", "ring"]).withColumn("p", part("parts")).withColumn("q", each("parts2"))
    right = rows.withColumnRenamed("ring", "ring2").join(still, ["comp", "ring2"]).withColumn("q", part("parts2")).withColumn("p", each("parts"))
    met = [side.select(*key, "node", "vector", "copies", F.lit(asks).alias("asks")) for side, asks in ((left, True), (right, False))]
    compared = met[0].union(met[1]).groupBy(*key).applyInArrow(_counted(tau), "node bigint, n bigint")
    return certain.union(compared).groupBy("node").agg(F.sum("n").alias("n_others"))


def near_duplicates(df: DataFrame, tau: float = 0.9, id: str = "vec_id", vector: str = "embedding", near: int = NEAR, most: int = MOST, reverse: int = REVERSE, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two vectors of one length link where their cosine, in doubles, is tau or more; equal vectors are one node of the graph,
    and each other copy is a link. component_id is the least vec_id that links reach, nulls aside. Vectors that are null,
    empty, zero, or hold a null or non-finite entry link with nothing and are components of their own. Rows with a null or
    repeated vec_id are rows like others (kept is false without an id). Other columns are ignored; an empty table
    gives an empty result. Vectors may have any length; those of different lengths do not link.
    """
    values = df.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    rows = materialise(values.where(usable("vector")))
    bad = values.where(~usable("vector")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    total, longest = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not total:
        return bad
    codes = materialise(nodes.select("node", "vector").mapInArrow(_encode, "node bigint, code binary"))
    low = tau - slack(longest)
    edges = neighbour_graph(codes, total, low, near, most, reverse, block, passes)
    pairs = edges.where(F.col("sim") >= low).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    end = lambda n: nodes.select(F.col("node").alias(n), F.col("vector").alias(f"v{n}"), F.col("copies").alias(f"c{n}"))
    links = materialise(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "ca", "cb", "va", "vb").mapInArrow(_confirm(tau), "a bigint, b bigint, ca bigint, cb bigint"))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("node"), F.col("root").alias("comp"))
    nodes = nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = links.select(F.col("a").alias("node"), F.col("cb").alias("n")).union(links.select("b", "ca")).groupBy("node").agg(F.sum("n").alias("n_others"))
    full = edges.where(F.col("sim") >= low).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= most).select("node", F.lit(True).alias("crowded"))
    nodes = materialise(nodes.join(full, "node", "left").join(counts, "node", "left").select("node", "vector", "copies", "least", "comp", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.coalesce("n_others", F.lit(0)).alias("n_others")))
    crowds = nodes.where("crowded").select("comp").distinct()
    if not nodes.where("crowded").isEmpty():
        exact = crowded_counts(nodes.join(crowds, "comp").select("comp", "node", "vector", "copies", "crowded"), tau).withColumnRenamed("n_others", "exact")
        nodes = nodes.join(exact, "node", "left").withColumn("n_others", F.coalesce("exact", "n_others"))
    first = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    nodes = materialise(nodes.join(first, "comp").select("vector", "copies", F.col("least").alias("vec_id"), (F.col("n_others") + F.col("copies") - 1).alias("n_links"), "component_id"))
    alone = nodes.where("copies = 1").select("vec_id", "n_links", "component_id")
    copied = rows.join(nodes.where("copies > 1").drop("vec_id"), "vector").select("vec_id", "n_links", "component_id")
    found = alone.union(copied).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return found.union(bad)
