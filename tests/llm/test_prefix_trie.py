"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shoebox.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth long, place string"


def slow(rows, share):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    if share:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - int(np.fmod(c, 5)), [])[: cut[c]] + v[cut[c] :] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        below = [sums(k) for k in kids.get(p, [])]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(own[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*T.COLUMNS).collect()), key=str)


def made(seed, convs=60, longest=12, words=3):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.randrange(-40, 120)
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None, ""]), r.choice(["", None, "é", "a" * 50][: words + 1]), 1, "x") for t in range(r.randrange(1, longest))]
    return rows


@pytest.mark.parametrize(("seed", "segment", "shard", "share"), [(1, 256, 1 << 18, True), (2, 3, 20, True), (3, 2, 7, False), (4, 1, 1, True)])
def test_trie_matches_dictionary(spark, seed, segment, shard, share):
    rows = made(seed) + [(None, 1, "user", "lost", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(T.prefix_trie(df, share, segment, shard)) == slow(rows, share)


def test_copies_prefixes_and_long_conversations(spark):
    rows = [(c, t, "user", f"t{t}", 0, "") for c in range(0, 300, 5) for t in range(6)]  # copies
    rows += [(7 * c, t, "user", f"t{t}" if t < 5 else f"{c}", 0, "") for c in range(301, 340) for t in range(c % 9 + 1)]
    rows += [(10**12, t, "assistant", str(t % 3), 0, "") for t in range(400)] + [(-3, t, "assistant", str(t % 3), 0, "") for t in range(350)] + [(10**12 + 1, 1, "user", "long " * 400_000, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    import sys

    sys.setrecursionlimit(10_000)
    for share in (False, True):
        assert got(T.prefix_trie(df, share, 16, 200)) == slow(rows, share)


def test_empty_and_turnless(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA), True).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "")], SCHEMA)).count() == 0
    one = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert got(T.prefix_trie(spark.createDataFrame([(one, 1, "a", "b", 1, "")], SCHEMA), True)) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_parentheses_find_what_closes():
    r = random.Random(0)
    for n in (1, 2, 40, 5000):
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or r.random() < 0.52):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        tree = T.Parentheses(np.array(bits, np.uint8))
        stack, want = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        assert tree.close(tree.opens).tolist() == [want[k] for k in tree.opens.tolist()]
        leaves = [sum(bits[k] == 1 and bits[k + 1] == 0 for k in range(a, want[a])) for a in tree.opens.tolist()]
        assert tree.leaf_pairs(tree.opens, tree.close(tree.opens)).tolist() == leaves
