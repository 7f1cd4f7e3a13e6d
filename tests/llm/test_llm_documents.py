"""The operators on documents against brute-force versions, on rows with nulls, ties, repeats, odd and very long texts."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from shoebox.llm import brown_lm, byte_bpe, exact_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup
from shoebox.llm.common import held_out

WORDS = [w for w in "the of and to in is was it for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, block string, bucket string, part string, key string, score string, kept string, label string, fp string, rank string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "", ".", ",", ".\n"]) for _ in range(n))


def rows():
    base = [prose(k, 120) for k in range(24)]
    texts = [
        *base, base[0], base[0].replace(" ", "  "), base[1].replace("the", "teh", 1), base[2] + " " + base[3], None, "", "   \n\t ", "a", "x\x00y  z", "don't  stop\n\n\nnow 12 3a!? end ",
        "émigré naïve Ωmega 漢字 \U0001f600 ok " * 3, "ab" * 6000, prose(99, 9000), base[5][:40] + base[6], "Hey " * 200, "\n".join([base[7][:90]] * 4), "#$% &&& ***" * 20, "ÀÉ " + base[8].upper(),
    ]
    out = [(k, t, ["en", "fr", None][k % 3], ["s0", "s0", "s1", None][k % 4]) for k, t in enumerate(texts)]
    out += [(3, base[3], "en", "s0"), (3, base[3], "en", "s0"), (None, base[4], "en", "s0"), (None, "no id here at all", None, None), (None, None, None, None)]
    return [(*r, len(r[1] or ""), *["clash"] * 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_byte_bpe_equals_the_library_and_round_trips(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(path), special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    want = [(r[0], np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows()]
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()) == Counter(want)
    assert out.count() == len(want)
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_words_of_any_white_space_are_independent(seed):
    r = random.Random(seed)
    text = "".join(r.choice([" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B's", "12", "é", "!?", "'s", "'", " ", " ", "\x1c", "\x85"]) for _ in range(60))
    words, sizes = byte_bpe.words_for(public_tokenizers.PATTERN)([b"a b", text.encode(), b"c\nd"])
    words = words.to_pylist()[sizes[0] : sizes[0] + sizes[1]]
    pattern = byte_bpe._pattern(public_tokenizers.PATTERN)
    parts = [m for w in words for m in pattern.findall((w[1:] if w[:1] == b"\x00" else w if w[:1] == b"\n" else b" " + w).decode())]
    assert parts == pattern.findall(text)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in rows():
        groups[normal(r[1])].append(r[0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = [(r[0], least(g := groups[normal(r[1])]), len(g), r[0] == least(g), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows()]
    for capacity in (512, 1):
        assert got(exact_dedup.exact_dedup(docs, capacity=capacity), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.mark.parametrize(("capacity", "depth"), [(50, 10), (1, 20), (5000, 10), (50, 0)])
def test_directory_doubles_until_no_bucket_is_overfull(spark, capacity, depth):
    r = random.Random(1)
    keys = {r.getrandbits(64) if r.random() < 0.7 else 5 << 54 | r.getrandbits(40) for _ in range(4000)}
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    bucket = {row.slot: row.bucket for row in exact_dedup.directory(df, depth, capacity).collect()}
    assert set(bucket) == {k >> (64 - depth) for k in keys}
    size, slots = Counter(bucket[k >> (64 - depth)] for k in keys), defaultdict(list)
    for slot, b in bucket.items():
        slots[b].append(slot)
    assert all(n <= capacity or len(slots[b]) == 1 for b, n in size.items())
    firsts = sorted(slots)
    assert all(max(slots[a]) < b for a, b in zip(firsts, firsts[1:], strict=False))  # buckets are ranges


def test_more_slots_than_may_be_broadcast(docs, monkeypatch):
    want = got(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    monkeypatch.setattr(exact_dedup, "BROADCAST_SLOTS", 0)
    assert got(exact_dedup.exact_dedup(docs, capacity=1), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_chains_keep_colliding_keys_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int64()), pa.array([7, 7, 7, 9]), pa.array([5, 2, 3, 1]), pa.array([1, 1, 2, 1]), pa.array(["a", "b", "a", "a"])], ["bucket", "key", "keep_id", "n", "text"])
    out = [r for b in exact_dedup._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["keep_id"], r["group_size"], r["text"]) for r in out] == [(7, 0, 3, 3, "a"), (7, 1, 2, 1, "b"), (9, 0, 1, 1, "a")]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(keys, pairs):
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(docs, none):
    own = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    known = [x for x in own if x[0] is not None]
    root = linked({i for i, _ in known}, [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 4])
    want = [(i, f - (1 << 64) if f >> 63 else f, root.get(i)) for i, f in own]
    assert got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_shards_lose_no_close_pair(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    fps = np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(6)], (np.uint64(7) << np.uint64(40)) ^ np.arange(2000, dtype=np.uint64)])
    fps = np.unique(fps)
    want = {(a, b) for k in range(0, len(fps), 500) for a, b in zip(*[x.tolist() for x in np.nonzero(np.bitwise_count(fps[k : k + 500, None] ^ fps[None]) <= 4)], strict=True) for a in [a + k] if a < b}
    found = set()
    for t, (mask, radius) in enumerate(simhash.BLOCKS):
        tree, _ = simhash.build_tree(fps[::3], mask, 5, t)
        shards = defaultdict(list)
        for leaf, r, m in simhash.route(tree, fps, mask, radius):
            shards[leaf].append((r, m))
        for parts in shards.values():
            r, m = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            for a, b in simhash.close_pairs(fps[r], m, mask, radius):
                found |= {(min(x, y), max(x, y)) for x, y in zip(r[a].tolist(), r[b].tolist(), strict=True)}
    assert found == want


def test_crowded_shards_are_dealt_and_dense_ones_end(spark):
    rng = np.random.default_rng(3)
    dense = np.uint64(0x0123456789ABCDEF) ^ np.unique((np.uint64(1) << rng.integers(22, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(22, 64, 3000, dtype=np.uint64)))  # one value in the first block
    fps = np.unique(np.concatenate([dense, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x), k) for k, x in enumerate(fps.view(np.int64))], "fp long, rep long")
    pairs = [(a + k, b) for k in range(0, len(fps), 500) for a, b in zip(*[x.tolist() for x in np.nonzero(np.bitwise_count(fps[k : k + 500, None] ^ fps[None]) <= 4)], strict=True)]
    want = linked(range(len(fps)), pairs)
    for crowded in (64, 1 << 14):
        found = linked(range(len(fps)), [(r.u, r.v) for r in simhash.links(df, crowded=crowded).collect()])
        assert found == want


def test_a_sieve_lets_no_key_pass(spark):
    from shoebox.llm.common import materialise, sieve

    df = spark.range(5000).selectExpr("if(id % 9 = 0, null, id) AS a", "cast(id AS string) AS b", "id AS _sieve")
    keys = materialise(df.where("_sieve % 7 = 0").select("a", "b"))
    clear, rest = sieve(df, keys, "a", "b")
    clear, rest = {r._sieve for r in clear.collect()}, {r._sieve for r in rest.collect()}
    assert clear | rest == set(range(5000)) and not clear & rest
    assert {k for k in range(5000) if k % 7 == 0} <= rest
    assert len(rest) < 5000 / 7 * 1.5
    assert sieve(df, materialise(keys.limit(0)), "a", "b")[1].count() == 0


def slow_cut(texts):
    seen, out = set(), []
    for t in texts:
        gone = [False] * len(t)
        for o in range(len(t) - 99):
            s = t[o : o + 100]
            if s in seen:
                gone[o : o + 100] = [True] * 100
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_multikey_quicksort_finds_equal_strings(seed):
    r = random.Random(seed)
    data = "".join(r.choice("ab") for _ in range(3000)).encode() * 2
    words = suffix_dedup.words_at(np.frombuffer(data, np.uint8), ">u8")
    starts, lengths = np.array([r.randrange(5000) for _ in range(4000)]), np.array([r.choice([8, 11, 16, 40]) for _ in range(4000)])
    rows, group = suffix_dedup.multikey_quicksort(words, starts, lengths, lengths.copy(), small=r.choice([1, 50, 10_000]))
    text = lambda k: data[starts[k] : starts[k] + lengths[k]]
    n = Counter((lengths[k], text(k)) for k in range(4000))
    assert sorted(rows.tolist()) == [k for k in range(4000) if n[lengths[k], text(k)] > 1]
    assert len({(g, text(k)) for k, g in zip(rows.tolist(), group.tolist(), strict=True)}) == len(set(group.tolist())) == len({(lengths[k], text(k)) for k in rows.tolist()})
    keys = [(lengths[k], text(k)) for k in rows.tolist()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(docs, none, hot):
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    want = [(r[0], *x) for r, x in zip(order, slow_cut([(r[1] or "").encode() for r in order]), strict=True)]
    out = suffix_dedup.cut_repeats(docs, hot=hot)
    assert got(out.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) k"), "doc_id", "n_bytes", "n_removed", "n_spans", "k") == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=repr)
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_kept_texts_leave_out_parts_of_characters(spark):
    df = spark.createDataFrame([(1, bytearray("aé".encode()[:2])), (2, bytearray(b"ok"))], "doc_id long, kept binary")
    assert got(suffix_dedup.kept_texts(df), "doc_id", "text") == [(1, "a"), (2, "ok")]


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = packing._tokenizer(path)
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows()]
    out = packing.pack(docs, path).collect()
    want = Counter((i, s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(len(x) for _, x in ids) / 2048 * 1.05 + 1
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_up_every_length_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2047, np.maximum(1, rng.lognormal(6, 1, 20_000).astype(int)))
    counts = np.bincount(lengths, minlength=2049)
    combos = packing.plan(counts)
    used = np.zeros(2049, int)
    for combination, n in combos:
        assert sum(a * k for a, k in combination) <= 2048
        for a, k in combination:
            used[a] += n * k
    assert (used == counts).all()
    assert sum(n for _, n in combos) * 2048 <= 1.005 * lengths.sum() + 2048


def test_least_squares_finds_an_exact_mixture():
    columns = [(3, 5), (2, 6), (4, 4)]
    counts = np.zeros(9)
    counts[[3, 5, 2, 6]] += [7, 7, 4, 4]
    counts[4] = 10
    assert np.allclose(packing.solve(columns, counts, 4000), [7, 4, 5], atol=0.05)


def test_quality_rules(docs, none):
    out = {}
    for r in quality_rules.apply_rules(docs).collect():
        out[r.doc_id, r.n_words, r.word_chars] = (r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.base_failed and r.kept)
    for r in rows():
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert out[r[0], len(w), sum(map(len, w))] == want
    assert quality_rules.apply_rules(none).count() == 0


def test_no_window_of_a_long_text_is_taken_for_another(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 600000), x -> hex(x * 7 + id)), ' ') || if(id = 1, ' A B C D E F A B C D E', '') AS text", "'en' AS lang", "'s' AS source")
    assert [r.n_repeat_words for r in quality_rules.document_stats(docs).orderBy("doc_id").collect()] == [0, 10]


def test_small_groups_lean_on_the_group_above(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20)), "en", "a") for k in range(400)]
    rows += [(1000 + k, " ".join(f"$#{k:03d}{j:02d}&" for j in range(20)), "en", "few") for k in range(3)]
    out = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[k] for k in range(400)) == 400
    assert not any(out[1000 + k] for k in range(3))


def test_sketch_buckets_cover_any_number(spark):
    values = [0, 1, 1023, 1024, 1025, 4099, 10**6 + 3, 10**15 + 7]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr(quality_rules.bucket("v")).collect()]
    assert out == [v >> max(0, v.bit_length() - 10) << max(0, v.bit_length() - 10) for v in values]


def test_thresholds_follow_their_group(spark):
    clean = [(k, " ".join(["word", "other", str(k)] + [f"w{k}x{j}" for j in range(20)]), "en", "a") for k in range(400)]
    symbols = [(1000 + k, " ".join(f"$#{k:03d}{j:02d}&" for j in range(20)), "en", "b") for k in range(400)]
    odd = [(2000, " ".join(f"$#000{j:02d}&" for j in range(20)), "en", "a")]
    df = spark.createDataFrame(clean + symbols + odd, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()}
    assert out[2000] is False
    assert sum(out[k] for k in range(400)) == 400
    assert sum(out[1000 + k] for k in range(400)) == 400


def test_quality_classifier_learns_from_its_own_rows_only(spark):
    data, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        data.append((k, " ".join(w + "###" for w in prose(k, 60).split()) if bad else prose(k, 60 + k % 50)))
        labels.append((k, int(not bad)))
    data += [(9001, None), (9002, ""), (None, prose(1, 50)), (5, data[5][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' label", "1 score", "0 features")
    known = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs, known, ~held_out(3, 1)).collect()
    assert len(out) == len(data)
    truth = dict(labels)
    judged = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in judged) >= 0.97 * len(judged) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels], "doc_id long, quality int")
    again = {(r.doc_id, round(r.score, 9)) for r in quality_classifier.quality_scores(docs, flipped.coalesce(1), ~held_out(3, 1)).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in quality_classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1), ~held_out(3, 1)).collect()}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.quality_scores(docs, empty, ~held_out(3, 1)).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), known, ~held_out(3, 1)).count() == 0


def test_quality_of_ties_and_very_long_texts(spark):
    data = [(k, " ".join(w + "###" for w in prose(k, 60).split()) if k % 3 == 0 else prose(k, 90)) for k in range(200)]
    data += [(1000, "word " * 700_000), (1001, "word " * 700_000), (1002, "x" * 3_000_000), (1003, ""), (1004, None), (1005, "\n" * 100_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, known, ~held_out(3, 1)).collect()}
    assert set(out) == {k for k, _ in data} and all(0 <= x <= 1 for x in out.values())
    assert out[1000] == out[1001] and out[1003] == out[1004] == out[1005]


def test_brown_lm(docs, none):
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), b"\n"]) for r in rows()]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in tokens if not is_held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, is_held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens), key=repr)
    out = brown_lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert brown_lm.score(none).count() == 0


def test_brown_lm_scores_by_brute_force(spark):
    r = random.Random(8)
    follows = {k: [r.randrange(30) for _ in range(3)] for k in range(30)}  # hidden classes and what may follow them

    def walk(n):
        k = r.randrange(30)
        for _ in range(n):
            yield f"c{k}w{int(20 * r.random() ** 2)}"
            k = r.choice(follows[k])

    texts = {k: " ".join(walk(r.randint(1, 150))) for k in range(150)} | {900: "", 901: "wholly new words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.withColumn("held_out", held_out(10, 0))
    coded, model, reached = brown_lm.fit(rows, 10, 0, exchanges=3)
    assert reached == sorted(reached) and reached[-1] > reached[0]
    tokens = {k: [*t.split(), None] for k, t in texts.items()}
    kinds, of = {}, {}
    for row in coded.collect():
        x = brown_lm.Coded(row.asDict())
        for i, end, size in zip(x.ids.tolist(), x.ends.tolist(), x.sizes.tolist(), strict=True):
            kinds[i] = x.kind[end - size + 1 : end + 1].tolist()
            for w, c in zip(tokens[i], kinds[i], strict=True):
                assert of.setdefault(w, c) == c  # a word has one class
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 10]
    count = Counter(w for k in train for w in tokens[k])
    pairs = Counter(p for k in train for p in zip([64, *kinds[k]], kinds[k], strict=False))
    size, begun = Counter(c for k in train for c in kinds[k]), Counter()
    for (a, _), m in pairs.items():
        begun[a] += m
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.words, model.documents) == (n, v, len(train))
    log = lambda c: sum(m * math.log(m) for m in c.values())
    assert abs(reached[-1] - (log(pairs) - log(size) - log(begun))) < 1e-3

    def token(w, before, kind, weight, out=0):
        c = max(0, count[w] - out)
        base = (c + 0.1) / (n - out + 0.1 * (v + 1))
        share = size[kind] / n
        step = share if before == brown_lm.UNKNOWN else (pairs[before, kind] - out + 5 * share) / (begun[before] - out + 5)
        return weight * step * c / max(1, size[kind] - out) + (1 - weight) * base

    def total(k, weight, out=0):
        return sum(math.log10(token(w, b, c, weight, out)) for w, b, c in zip(tokens[k], [64, *kinds[k]], kinds[k], strict=False))

    assert model.weight == max(brown_lm.WEIGHTS, key=lambda w: sum(total(k, w, 1) for k in train)) > 0
    once = {r.doc_id: r.score for r in brown_lm.score(docs).collect()}
    coded, model, _ = brown_lm.fit(rows, 10, 0)
    kinds = {i: x.kind[end - size + 1 : end + 1].tolist() for row in coded.collect() for x in [brown_lm.Coded(row.asDict())] for i, end, size in zip(x.ids.tolist(), x.ends.tolist(), x.sizes.tolist(), strict=True)}
    pairs = Counter(p for k in train for p in zip([64, *kinds[k]], kinds[k], strict=False))
    size, begun = Counter(c for k in train for c in kinds[k]), Counter()
    for (a, _), m in pairs.items():
        begun[a] += m
    assert all(abs(once[k] - total(k, model.weight)) < 1e-6 for k in texts)


def test_an_exchange_moves_words_to_where_they_gain():
    r = np.random.default_rng(2)
    of = np.repeat([0, 1], 20)
    text = [int(r.choice(np.flatnonzero(of == k % 2))) for k in range(4000)]
    classes = of.astype(np.uint8).copy()
    classes[[3, 25]] = 1, 0  # two words in the wrong class
    kind = np.array([brown_lm.CLASSES, *classes[text], brown_lm.CLASSES])
    pairs = np.zeros((brown_lm.CLASSES + 2,) * 2)
    np.add.at(pairs, (kind[:-1], kind[1:]), 1)
    keys, n = np.unique(np.concatenate([np.array(text) * brown_lm._G + kind[:-2], np.array(text) * brown_lm._G + brown_lm.CLASSES + 1 + kind[2:]]), return_counts=True)
    assert (brown_lm.moved(keys, n, classes, pairs, np.ones(40, bool)) == of).all()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_brown_lm_beats_unigrams_on_the_documents(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no data")
    out = brown_lm.score(spark.read.parquet(path)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert out.s > out.b


def test_brown_lm_beats_unigrams_on_patterned_text(spark):
    r = random.Random(5)
    animals, verbs = [f"animal{k}" for k in range(30)], [f"verb{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(f"the {r.choice(animals)} did {r.choice(verbs)} ." for _ in range(30))) for k in range(300)], "doc_id long, text string")
    out = [x for x in brown_lm.score(docs).collect() if x.held_out]
    assert len(out) > 10
    assert all(x.score > x.base_score + 10 for x in out)


def test_texts_of_megabytes_are_whole(spark):
    """Texts of several megabytes, one of them a single word, through every operator on texts, beside a copy and short ones."""
    import tiktoken

    long = prose(5, 700_000)
    made = [(1, long), (2, "x" * 2_000_000), (3, long), (4, long + " end"), (5, "short"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["clash"] * 9) for i, t in made], SCHEMA).repartition(2)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(path), special_tokens={})
    for i, t in made:
        assert bytes(out[i].decoded) == (t or "").encode()
        if i in (1, 5, 6):
            assert bytes(out[i].ids) == np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found[1] == found[3] and found[1][1] == found[4][1] == 1 and found[2][1] == 2
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.cut_repeats(docs).collect()}
    assert cut[1][1] == 0 and cut[3] == (len(long), len(long), 1) and cut[4][1:] == (len(long), 1) and cut[2] == (2_000_000, 1_999_999, 1)
    packed = [(r.doc_id, r.start, r.length, r.doc_tokens) for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()]
    for i in range(1, 7):
        own = sorted(r[1:] for r in packed if r[0] == i)
        assert [s for s, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
    scored = {r.doc_id: (r.n_tokens, r.n_known <= r.n_tokens) for r in brown_lm.score(docs).collect()}
    assert scored == {1: (700_001, True), 3: (700_001, True), 4: (700_002, True), 2: (2, True), 5: (2, True), 6: (1, True)}


def test_a_text_in_half_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    made = [(k, "a notice that stands  everywhere" if k % 2 else f"text {k // 4}") for k in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["clash"] * 9) for i, t in made], SCHEMA).repartition(4)
    got_ = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got_ == {k: (1, 100, k == 1) if k % 2 else (k - k % 4, 2, k % 4 == 0) for k in range(200)}


def test_rules_move_no_document(spark, docs):
    plan = quality_rules.apply_rules(docs)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "BuildRight" in text
