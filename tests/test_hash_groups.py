"""Hamming joins and greedy leaders over hashes against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import similarity as S

SCHEMA = "scope string, ord long, hi long, lo long"


def made(seed, n, shared=0, scopes=2, groups=0):
    """Distinct random hashes whose first `shared` bits agree, and near copies of some."""
    r = random.Random(seed)
    words = [r.getrandbits(64 - shared) for _ in range(n)]
    for _ in range(groups):
        w = r.choice(words)
        words += [w ^ sum(1 << r.randrange(64 - shared) for _ in range(r.randrange(1, 4))) for _ in range(6)]
    rows = {(f"s{r.randrange(scopes)}", w) for w in words}
    ords = r.sample(range(10 * len(rows)), len(rows))
    return [(s, o, w >> 32, w & 0xFFFFFFFF) for (s, w), o in zip(sorted(rows), ords, strict=True)]


def near(rows, t):
    out = {}
    for k, (s, o, h, lo) in enumerate(rows):
        for s2, o2, h2, lo2 in rows[k + 1 :]:
            d = (h ^ h2).bit_count() + (lo ^ lo2).bit_count()
            if s == s2 and d <= t:
                out[min(o, o2), max(o, o2)] = d
    return out


def leaders(rows, t):
    later, led = {}, {}
    for a, b in near(rows, t):
        later.setdefault(a, []).append(b)
    for o in sorted(r[1] for r in rows):
        if o not in led:
            led[o] = o
            for b in later.get(o, []):
                led.setdefault(b, o)
    return led


@pytest.mark.parametrize(("seed", "shared", "t", "crowd", "group"), [(1, 0, 5, 256, 2048), (2, 48, 5, 3, 5), (3, 54, 2, 4, 3)])
def test_pairs_come_out_once(spark, seed, shared, t, crowd, group):
    rows = made(seed, 120, shared, groups=15)
    got = S.hash_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), t, crowd=crowd, group=group).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.distance for r in got} == near(rows, t)


@pytest.mark.parametrize(("seed", "shared", "t", "most", "local", "crowd"), [(2, 50, 5, 2, 1 << 20, 4), (3, 52, 3, 1, 0, 1000), (5, 57, 5, 1, 1 << 20, 5)])
def test_leaders_match_a_scan(spark, seed, shared, t, most, local, crowd):
    rows = made(seed, 150, shared, groups=10)
    got = {r.node: r.leader for r in S.hash_leaders(spark.createDataFrame(rows, SCHEMA).repartition(3), t, most=most, local=local, crowd=crowd, group=20).collect()}
    assert got == leaders(rows, t)


def test_masks_part_all_bits_evenly(spark):
    rows = made(9, 400, 40)
    masks = S._masks(spark.createDataFrame(rows, SCHEMA), 7)
    assert sum(masks) == (1 << 64) - 1 and all((m & ((1 << 24) - 1)).bit_count() in (3, 4) for m in masks)
    assert S.hash_leaders(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_many_hashes_that_agree_in_most_bits(spark):
    """100,000 hashes of equal first 40 bits: the work is spread, and lists stay short."""
    r = random.Random(0)
    words = r.sample(range(1 << 24), 100_000)
    df = spark.createDataFrame([("", k, 0x12345678, w) for k, w in enumerate(words)], SCHEMA).repartition(8)
    led = dict(S.hash_leaders(df, 5).collect())
    assert len(led) == len(words)
    heads = [words[k] for k in sorted(led) if led[k] == k]
    for a, b in ((r.choice(heads), r.choice(heads)) for _ in range(20_000)):
        assert a == b or (a ^ b).bit_count() > 5
    some = r.sample(sorted(k for k in led if led[k] != k), 300)
    first = sorted(k for k in led if led[k] == k)
    for k in some:
        assert led[k] == next(h for h in first if (words[h] ^ words[k]).bit_count() <= 5)


def test_sides_as_long_as_the_table_are_not_broadcast(spark):
    """Estimates after explode() and checkpoint() are far too small; a broadcast of 25 million keys ended the driver."""
    rows = spark.range(50).select(F.lit("").alias("scope"), F.col("id").alias("ord"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("hi"), F.col("id").alias("lo"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(S.hash_pairs(rows, 5))
    media = spark.range(50).select("id", F.col("id").alias("ord"), F.format_string("p:%016x", F.expr("id div 2")).alias("perceptual_hash"))
    groups = S.duplicate_groups(media, 5, scope=None)
    assert "Broadcast" not in plan(groups)
    assert "Broadcast" not in plan(S.without_duplicates(media, groups))
