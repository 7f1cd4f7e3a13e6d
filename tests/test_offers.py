"""Offers of near vectors: what a block task holds, pairs that single precision can't tell apart, rounds that end."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox.operators import people, vectors

TAU = 0.7


class Held:
    """Takes the place of a DataFrame and keeps the function that its tasks run."""

    def applyInArrow(self, f, schema):  # noqa: N802
        self.f = f
        return self

    def where(self, *_):
        return self

    groupBy = agg = where  # noqa: N815


def _task(monkeypatch, offers):
    held = Held()
    monkeypatch.setattr(vectors, "_blocks", lambda *_: held)
    offers(held, TAU)
    return held.f


def _table(m, **columns):
    n = len(m)
    own = (np.arange(n) >= n // 2).astype(np.int64)
    return pa.table({"id": np.arange(n), "vector": pa.array(m.tolist()), "own": own, "i": np.zeros(n, np.int64), "j": np.ones(n, np.int64), "pivot": np.arange(n, dtype=np.int32) % 7, **columns})


def _run(f, table):
    tracemalloc.start()
    out = f(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return {r["id"]: r["offer"] for r in out.to_pylist()}, peak


def test_a_block_task_looks_for_the_nearest_without_all_distances(spark, monkeypatch):
    """Before, it went through a tile's distances in doubles again and again: 169 MB, and most of the time."""
    r = np.random.default_rng(3)
    n = 4400
    m, ord, known = r.normal(size=(n, 16)), r.permutation(n), r.random(n) < 0.1
    number = lambda some: pa.array([int(o) if s else None for o, s in zip(ord, some, strict=True)], pa.int64())
    got, peak = _run(_task(monkeypatch, vectors.nearest_offers), _table(m, asks=number(~known), fixed=number(known), early=number(~known)))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for x in np.flatnonzero(~known):
        others = np.arange(n // 2, n) if x < n // 2 else np.arange(n // 2)
        others = others[known[others] | (ord[others] < ord[x])]
        d = 1 - u[others] @ u[x]
        if len(d) and d.min() < TAU:
            want[x] = ord[others[d.argmin()]]
    assert got == want and len(want) > 3500
    assert peak < 80e6


def test_a_block_task_looks_for_the_least_without_all_distances(spark, monkeypatch):
    r = np.random.default_rng(4)
    n = 4400
    m, asks = r.normal(size=(n, 16)), r.random(n) < 0.7
    low = [int(x) if s else None for x, s in zip(r.integers(0, 900, n), r.random(n) < 0.5, strict=True)]
    got, peak = _run(_task(monkeypatch, vectors.least_offers), _table(m, asks=pa.array(asks), low=pa.array(low, pa.int64())))
    u, value = m / np.linalg.norm(m, axis=1, keepdims=True), np.array([np.inf if x is None else x for x in low])
    want = {}
    for x in np.flatnonzero(asks):
        others = np.arange(n // 2, n) if x < n // 2 else np.arange(n // 2)
        least = value[others[1 - u[others] @ u[x] < TAU]].min(initial=np.inf)
        if np.isfinite(least):
            want[x] = int(least)
    assert got == want and len(want) > 2000
    assert peak < 40e6


@pytest.mark.parametrize("beyond, reached", [(-0.5, 0), (0.5, 1), (20.5, 21), (1e9, 60)])
def test_distances_that_differ_by_a_billionth(spark, beyond, reached):
    """60 rows at 0.3 + k * 1e-9 of the row that asks; the bound lies between two of them."""
    near = 0.7 - np.arange(60) * 1e-9
    ask = np.random.default_rng(5).permutation(60)
    rows = [(int(k), [float(near[k]), float(np.sqrt(1 - near[k] ** 2))], None, None, int(ask[k])) for k in range(60)] + [(60, [1.0, 0.0], 60, None, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, asks long, fixed long, early long").repartition(3)
    tau = 0.3 + beyond * 1e-9
    assert {r.id: r.offer for r in vectors.nearest_offers(df, tau, 20).collect()} == ({60: int(ask[0])} if reached else {})
    df = df.select("id", "vector", F.col("asks").isNotNull().alias("asks"), F.col("early").alias("low"))
    assert {r.id: r.offer for r in vectors.least_offers(df, tau, 20).collect()} == ({60: int(ask[:reached].min())} if reached else {})


def test_vectors_that_are_not_finite_are_near_nothing(spark):
    rows = [(0, [1.0, 0.0], 5, None, 5), (1, [float("nan"), 1.0], 6, None, 1), (2, [1.0, 0.1], None, 2, None), (3, [float("inf"), 1.0], None, 3, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, asks long, fixed long, early long")
    assert {r.id: r.offer for r in vectors.nearest_offers(df, 0.5).collect()} == {0: 2}


def test_rounds_end_when_every_class_is_near_an_assigned_face(spark, monkeypatch):
    """Before, a further round sent all vectors again to tell nobody anything."""
    m = np.random.default_rng(6).normal(size=(80, 3)) * 0.05 + [1, 1, 1]
    rows = [(k, k, "p" if k % 10 == 0 else None, v.tolist()) for k, v in enumerate(m)]
    rounds, least = [], people.least_offers
    monkeypatch.setattr(people, "least_offers", lambda *a, **k: (rounds.append(1), least(*a, **k))[1])
    got = people.assign_known(spark.createDataFrame(rows, "id long, ord long, person string, vector array<double>"), TAU).collect()
    assert {r.person for r in got} == {"p"} and len(got) == 80
    assert len(rounds) == 1


def test_pairs_of_blocks_are_dealt_to_partitions_of_their_own(spark):
    """Before, partitions were merged by their bytes: 36 pairs of 51,282 vectors made nine tasks."""
    df = spark.range(20_000).select("id", F.array(*[F.randn(k) for k in range(4)]).alias("vector"))
    at = vectors._blocks(df, None, None, (), 1.5).select(F.spark_partition_id().alias("p"), "i", "j").distinct().collect()
    pairs = {(r.i, r.j) for r in at}
    assert len(at) == len(pairs) == 36
    assert len({r.p for r in at}) >= 24
