"""The near-duplicate stage against all pairs of documents."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from shoebox.llm import common, simhash
from shoebox.llm import jaccard as J

from .test_llm_documents import SCHEMA, prose


def changed(text, seed, words):
    r, out = random.Random(seed), text.split(" ")
    for k in r.sample(range(len(out)), words):
        out[k] = f"w{r.randrange(10**6)}"
    return " ".join(out)


def texts():
    out = [(100 + k, prose(k, 200)) for k in range(10)]
    out += [(200 + 10 * k + c, changed(prose(k, 200), 31 * k + c, c)) for k in range(10) for c in range(1, 7)]
    out += [(1000 - k, changed(prose(77, 150), k, 2)) for k in range(60)]  # one key, more than SMALL members
    chain = prose(88, 150)
    for k in range(40):
        chain = changed(chain, k, 3)
        out.append((2000 + k, chain))
    out += [(5, "Four words  stand here"), (6, "four words stand here"), (7, "four words stand"), (8, ""), (9, None), (9, prose(3, 200) + " more")]
    return [*out, (None, changed(prose(2, 200), 5, 1)), (None, prose(55, 80)), (None, prose(55, 80))]


def survivors(docs):
    """doc_id and text of the least row of each component, by comparing all pairs of shingle sets."""
    words = [(t or "").lower().split() for _, t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is not None)
    return {min((docs[k] for k in range(len(docs)) if root[k] == r), key=order) for r in set(root)}


def test_near_copies_leaves_what_all_pairs_at_80_percent_leave(spark):
    import corpus_pipeline as P

    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["clash"] * 9) for i, t in rows], SCHEMA).repartition(3)
    out = P.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = survivors(rows)
    assert len(got) == len(set(got))
    assert len(want) < len(rows) - 60
    assert {(i, t or "") for i, t in got} == {(i, t or "") for i, t in want}


def test_similar_pairs_meet_in_a_shard():
    base = [prose(k, 300) for k in range(150)]
    pairs = [(J.shingles(t.encode()), J.shingles(changed(t, k, 6).encode())) for k, t in enumerate(base)]
    close = [(a, b) for a, b in pairs if J.similar(a, b)]
    assert len(close) > 100

    def meet(a, b):
        bits = simhash.set_fingerprints(a) ^ simhash.set_fingerprints(b)
        near = lambda w: int(bits[w]).bit_count() + (int(bits[w ^ 1]) & 0xFFFFFFFF).bit_count() <= simhash.LANE_BITS
        return any(near(w) and int(x & np.uint64(mask)).bit_count() <= radius for w, x in enumerate(bits) for mask, radius in simhash.BLOCKS)

    assert sum(meet(a, b) for a, b in close) >= 0.99 * len(close)


def test_majorities_count_bits():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 64, 65, 20_000):
        found = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        own = np.arange(1, 2 * simhash.LANES + 1, dtype=np.uint64)[:, None] * simhash._MIX
        hashes = J.mixed(found[None] + own)
        assert simhash.set_fingerprints(found).tolist() == [sum(1 << b for b in range(64) if 2 * int((row >> np.uint64(b) & np.uint64(1)).sum()) > n) for row in hashes]


def test_links_join_a_large_group_without_all_its_pairs(spark):
    sets = [(k, J.packed(np.concatenate([np.arange(100), [1000 + k]]).astype(np.uint64) << np.uint64(32))) for k in range(300)]
    table = spark.createDataFrame(sets, "node long, hashes binary")
    members = table.select(F.lit(1).cast("long").alias("key"), "node", F.lit(101).alias("size"))
    out = J.links(members, table)
    assert {r.v for r in out.collect()} | {r.u for r in out.collect()} == set(range(300))
    assert out.count() < 600


def test_sets_move_whole():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 40_000):
        found = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        assert J.unpacked(J.packed(found)).tolist() == np.unique(found >> np.uint64(64 - J.KEPT)).tolist()


def test_pairs_at_exactly_80_percent_are_found(spark):
    """Pairs of texts of n + 4 words whose last words differ: of n shingles each, 8 in 9 are shared, a similarity of 0.8."""
    rows, want = [], 0
    for size in (9, 18, 45, 90, 270):
        for k in range(60):
            words = prose(1000 * size + k, size + 4).split()
            words = [f"{w}{j}" for j, w in enumerate(words)]
            other = words[: -(size // 9)] + [f"other{k}x{j}" for j in range(size // 9)]
            rows += [(len(rows) + 1, " ".join(words)), (len(rows) + 2, " ".join(other))]
            a, b = J.shingles(" ".join(words).encode()), J.shingles(" ".join(other).encode())
            assert 5 * len(np.intersect1d(a, b)) == 4 * len(np.union1d(a, b))
            want += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.near_copies(docs).where("kept").count()
    assert len(rows) - want <= kept <= len(rows) - 0.97 * want


def test_finished_steps_leave_no_shuffles(spark, monkeypatch):
    """When sets begin to meet, the files of the trees' and the texts' shuffles are gone."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(disk.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(disk.getAllFiles().size()))
    rows = [(k, " ".join(f"w{(k % 40) * 50 + n}" for n in range(30)) + f" {k}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, links = [], simhash.jaccard.links

    def look(*args):
        for _ in range(20):  # Spark deletes beside the driver
            if (n := files()) <= before:
                break
            time.sleep(0.5)
        seen.append(n)
        return links(*args)

    common.let_go(spark)
    time.sleep(3)
    before = files()
    monkeypatch.setattr(simhash.jaccard, "links", look)
    assert simhash.near_copies(docs).where("kept").count() == 40
    assert seen and seen[0] <= before
