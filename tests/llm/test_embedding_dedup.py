"""Near-duplicate embeddings against all pairs."""

import math

import numpy as np
import pytest

from shoebox.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, a long, n long, node string"


def slow(rows, tau=0.9):
    good = [k for k, (_, v, *_) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    parent = {k: k for k in range(len(rows))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    for d in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == d]
        m = np.array([rows[k][1] for k in own], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= tau
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[own[a]] += 1
            if a < b:
                x, y = find(own[a]), find(own[b])
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, *_) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, links[k], least.get(find(k)), i is not None and i == least.get(find(k))) for k, (i, *_) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def f32(m):
    return [[float(np.float32(x)) for x in row] for row in m]


def made(n, d, seed, groups=()):
    """Random vectors, and groups (size, spread) of near copies."""
    r = np.random.default_rng(seed)
    m = [r.normal(size=(n, d))]
    for size, spread in groups:
        base = r.normal(size=(1, d))
        m.append(base + spread * r.normal(size=(size, d)))
    m = np.concatenate(m)
    order = r.permutation(len(m))
    return [(int(i), v, 1, 2, "x") for i, v in zip(order, f32(m), strict=True)]


@pytest.mark.parametrize(("n", "d", "groups", "most", "block"), [(150, 8, [(40, 0.2), (9, 0.1), (2, 0.1)], 64, 1024), (400, 16, [(60, 0.15), (50, 0.35), (3, 0.2), (2, 0.05)], 16, 64), (300, 6, [(200, 0.3)], 12, 32)])
def test_links_match_all_pairs(spark, n, d, groups, most, block):
    rows = made(n, d, n, groups)
    assert got(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), most=most, block=block)) == slow(rows)


def test_nulls_copies_and_lengths(spark):
    rows = made(40, 8, 5, [(6, 0.1)])
    rows += [(500 + k, rows[3][1], 0, 0, "") for k in range(30)] + [(None, rows[3][1], 0, 0, ""), (3, rows[4][1], 0, 0, ""), (3, rows[9][1], 0, 0, ""), (-7, [2 * x for x in rows[3][1]], 0, 0, "")]
    rows += [(600, None, 0, 0, ""), (601, [], 0, 0, ""), (602, [0.0] * 8, 0, 0, ""), (603, [0.0] * 8, 0, 0, ""), (604, [math.nan] * 8, 0, 0, ""), (605, [math.inf, *[1.0] * 7], 0, 0, ""), (606, [None, *[1.0] * 7], 0, 0, ""), (None, None, 0, 0, "")]
    rows += [(700, [1.0, 2.0], 0, 0, ""), (701, [1.0, 2.1], 0, 0, ""), (702, [1e30, 2e30], 0, 0, ""), (703, [1.0], 0, 0, ""), (704, [5.0], 0, 0, ""), (705, [-5.0], 0, 0, "")]
    assert got(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))) == slow(rows)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(E.near_duplicates(spark.createDataFrame(rows[-6:-5], SCHEMA))) == [(700, 0, 700, True)]


def test_rings_settle_dense_groups(spark):
    r = np.random.default_rng(3)
    m = f32(np.concatenate([r.normal(size=(1, 12)) + 0.05 * r.normal(size=(300, 12)), r.normal(size=(1, 12)) + 0.3 * r.normal(size=(200, 12))]))
    rows = [(0 if k < 300 else 1, k, v, k % 3 + 1, k % 2 == 0) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "comp long, node long, vector array<float>, copies long, crowded boolean")
    found = dict(E.crowded_counts(df, 0.9, meet=40).collect())
    u = np.array(m, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    copies = np.array([x[3] for x in rows])
    comp = np.array([x[0] for x in rows])
    assert found == {k: int((copies * near[k] * (comp == comp[k])).sum()) for k in range(500) if k % 2 == 0}


def test_audit_sees_missing_links(spark):
    rows = made(100, 8, 1, [(20, 0.1)])
    nodes = spark.createDataFrame([(k, v) for k, v, *_ in rows], "node long, vector array<float>").mapInArrow(E._encode, "node bigint, code binary")
    edges = E.merged(E.seeded(nodes, 120, 0, 0.9, 12, 64, 1024), 0.9, 12, 64)
    assert E.audit(nodes, edges, 0.9, 64) == 1.0
    assert E.audit(nodes, edges.where("a % 2 = 0"), 0.9, 64) < 0.9
