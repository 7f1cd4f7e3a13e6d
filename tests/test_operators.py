"""Order-dependent and geometric operators against plain sequential versions."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import boxes, geo, people, rounds, similarity, text, vectors


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 1 - (float(np.dot(a, b)) / n if n else 0.0)


def clustered(seed, n, dim=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    out = [centres[r.integers(5)] + r.normal(size=dim) * 0.35 for _ in range(n)]
    out[n // 2] = out[0].copy()
    out[n // 3] = np.zeros(dim)
    return [np.asarray(v, np.float32) for v in out]


@pytest.mark.parametrize("seed", range(3))
def test_knn(spark, seed):
    v = clustered(seed, 60)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, []), (902, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    out = vectors.knn(df.where("vec_id % 7 = 0"), df, 4).collect()
    for q in range(0, 60, 7):
        want = sorted(range(60), key=lambda k: (round(cosine(v[q], v[k]) - 1, 12), k))[:4]
        assert [r.id for r in sorted((r for r in out if r.query == q), key=lambda r: r["rank"])] == want
    assert vectors.knn(df.limit(0), df, 4).count() == 0
    assert vectors.knn(df.where("vec_id = 1"), df, 0).count() == 20
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert vectors.knn(e.where("vec_id = 0"), e.where("vec_id = 1"), 1, min_score=0.1).count() == 0


def test_link_counts(spark):
    v = clustered(1, 50)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    out = {r.id: (r.class_id, r.n_links) for r in vectors.link_counts(df, 0.2).collect()}
    for k in range(50):
        same = [j for j in range(50) if (v[j] == v[k]).all()]
        assert out[k] == (min(same), sum(j != k and cosine(v[j], v[k]) < 0.2 for j in range(50)))


def test_far_blocks_never_meet(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 24))
    v = [centres[k % 40] + 0.1 * r.normal(size=24) for k in range(1200)] + [np.zeros(24)]
    df = spark.createDataFrame([(k, x.tolist(), str(k % 2)) for k, x in enumerate(v)], "id long, vector array<double>, scope string").cache()
    u = np.array(v[:-1])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for scope, tau in ((None, 0.1), ("scope", 0.3)):
        want = {(a, b) for a, b in zip(*np.nonzero(d < tau)) if a < b and (scope is None or a % 2 == b % 2)}
        assert {(x.a, x.b) for x in vectors.close_pairs(df, tau, 50, scope).collect()} == want
    blocks = {(b.own, b.i, b.j) for b in vectors._blocks(df, 50, None, (), 0.1).select("own", "i", "j").distinct().collect()}
    n = len({own for own, _, _ in blocks})
    multiplied = {(i, j) for own, i, j in blocks if (i, i, j) in blocks and (j, i, j) in blocks}
    assert len(multiplied) < n * (n + 1) / 2 / 5


def test_inverted_file_finds_most_neighbours(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    centres = vectors.fit_lists(df, 8)
    q = df.where("vec_id % 20 = 0")
    exact = {(x.query, x.id) for x in vectors.knn(q, df, 10).collect()}
    found = {(x.query, x.id) for x in vectors.ivf_search(q, df, centres, 5, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(x.query, x.id) for x in vectors.ivf_search(q, df, centres, 8, 10).collect()} == exact
    assert 1 <= vectors.pick_probes(df, centres, 10, 0.5) <= vectors.pick_probes(df, centres, 10) <= 8


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_inverted_file_on_the_embeddings(spark, sf):
    from shoebox.plans import search

    sf_dir = f"/root/testdata/sf{sf}"
    if not os.path.exists(sf_dir):
        pytest.skip("no data")
    exact = {(x.query, x.id) for x in search.knn_exact(spark, sf_dir).collect()}
    found = {(x.query, x.id) for x in search.ivf_search(spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lists = int(e.count() ** 0.5)
    assert vectors.pick_probes(e, vectors.fit_lists(e, lists), 10) < lists / 2


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    v = clustered(3, 60)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<float>")
    rows = lambda d: {(r.query, r.id, r["rank"]) for r in d.collect()}
    few = rows(vectors.knn(df.where("vec_id < 900"), df, 4))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 25)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 20)
    assert rows(vectors.knn(df, df, 4)) == few | {(901, 901, 1)}


def test_close_pairs_of_scopes(spark):
    v = clustered(5, 60)
    df = spark.createDataFrame([(k, x.tolist(), ["a", "b", None][k % 3]) for k, x in enumerate(v)], "id long, vector array<float>, scope string")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 and cosine(v[a], v[b]) < 0.2}
    for rows in (7, 2048):
        assert {(r.a, r.b) for r in vectors.close_pairs(df, 0.2, rows, "scope").collect()} == want


@pytest.mark.parametrize("local", [1 << 20, 2])
def test_long_chains_of_similar_hashes(spark, local):
    n = 300 if local > 2 else 12
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.leader) for r in similarity.greedy_leaders(nodes, edges, local).collect()} == {(k, k - k % 2) for k in range(n)}


def slow_groups(hashes, t):
    seen, out = set(), []
    for i, a in enumerate(hashes):
        if a is None or i in seen:
            continue
        own = [i] + [j for j in range(i + 1, len(hashes)) if hashes[j] is not None and j not in seen and (a ^ hashes[j]).bit_count() <= t]
        seen |= set(own)
        if len(own) > 1:
            out.append((own, (a ^ hashes[own[-1]]).bit_count()))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("t", [0, 2, 5])
def test_duplicate_groups(spark, seed, t):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(6)]
    hashes = []
    for _ in range(60):
        h = r.choice(base)
        for _ in range(r.randint(0, 4)):
            h ^= 1 << r.randrange(64)
        hashes.append(h if r.random() > 0.05 else None)
    df = spark.createDataFrame([(f"m{k:03d}", k, f"p:{h:016x}" if h is not None else r.choice(["", "p:xyz", None])) for k, h in enumerate(hashes)], "id string, ord long, perceptual_hash string")
    out = similarity.duplicate_groups(df, t, scope=None)
    want = {(f"m{j:03d}", f"m{own[0]:03d}", j == own[0], len(own), d) for own, d in slow_groups(hashes, t) for j in own}
    assert {tuple(x) for x in out.select("id", "leader_id", "leads", "group_size", "distance").collect()} == want
    if t == 5:
        drop = {i for i, _, leads, _, _ in want if not leads}
        assert {x.id for x in similarity.without_duplicates(df, out).collect()} == {f"m{k:03d}" for k in range(60)} - drop


def slow_assign(v, person, tau, found):
    person, parent = list(person), {}
    for i in range(len(v)):
        if person[i] is not None:
            continue
        near = [(cosine(v[i], v[j]), j) for j in range(len(v)) if j != i and person[j] is not None and cosine(v[i], v[j]) < tau]
        if near:
            best = min(d for d, _ in near)
            person[i] = person[min(j for d, j in near if d <= best + 1e-12)]
        elif found:
            person[i] = f"new:{i}"
        parent[i] = person[i]
    return person


@pytest.mark.parametrize("seed", range(6))
def test_assign_faces(spark, seed):
    v = clustered(seed, 36)
    person = [f"p{k % 3}" if k % 9 == 4 and seed else None for k in range(36)]
    df = spark.createDataFrame([(k, k, p, x.tolist()) for k, (p, x) in enumerate(zip(person, v, strict=True))], "id long, ord long, person string, vector array<float>")
    tau = 0.15
    assert [r.person for r in people.assign_faces(df, tau).orderBy("id").collect()] == slow_assign(v, person, tau, True)
    fresh = {r.person: (r.thumbnail_face, r.faces) for r in people.new_people(people.assign_faces(df, tau)).collect()}
    names = [p for p in slow_assign(v, person, tau, True) if p.startswith("new:")]
    assert fresh == {p: (int(p[4:]), names.count(p)) for p in names}
    few = {r.person for r in people.assign_faces(df, tau, min_faces=3).collect()}
    assert {p for p in few if p.startswith("new:")} == {p for p in names if names.count(p) >= 3}
    assert [r.person for r in people.assign_known(df, tau).orderBy("id").collect()] == slow_assign(v, person, tau, False)


def slow_merges(c, n, tau):
    name, size, gone, out = list(range(len(c))), list(n), set(), []
    for i in range(len(c)):
        if name[i] in gone:
            continue
        for j in range(i + 1, len(c)):
            if name[j] in gone or cosine(c[i], c[j]) >= tau:
                continue
            a, b = (name[i], name[j]) if size[j] > size[i] else (name[j], name[i])
            name[i] = b
            size[i] += size[j]
            if a != b:
                gone.add(a)
                out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_sparse_replay_equals_the_dense_loop(seed):
    r = np.random.default_rng(seed)
    c, n = clustered(seed, 20), r.integers(1, 9, 20).tolist()
    edges = {i: [j for j in range(i + 1, 20) if cosine(c[i], c[j]) < 0.3] for i in range(20)}
    assert [m[2:] for m in people.replay_merges(n, edges)] == slow_merges(c, n, 0.3)


def test_merge_plan_and_chains(spark):
    c, n = clustered(3, 15), [1, 5, 2, 8, 1, 1, 9, 2, 2, 3, 1, 7, 1, 1, 2]
    df = spark.createDataFrame([(f"p{k}", k, n[k], [float(x) for x in c[k]]) for k in range(15)], "person string, ord long, n long, centroid array<double>")
    plan = people.merge_plan(df, 0.3).orderBy("step", "met").collect()
    assert [(r.source, r.target) for r in plan] == [(f"p{a}", f"p{b}") for a, b in slow_merges(c, n, 0.3)]
    rounds = people.merge_plan(df, 0.3, local=0).orderBy("step", "met").collect()
    assert rounds == plan
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert {tuple(r) for r in people.final_names(chain).collect()} == {("a", "c"), ("b", "c"), ("x", "y")}


@pytest.mark.parametrize(("seed", "n", "links"), [(0, 60, 90), (1, 200, 260), (2, 40, 400)])
def test_merges_in_rounds_equal_the_replay(spark, seed, n, links):
    r = random.Random(seed)
    sizes = [r.randrange(1, 6) for _ in range(n)]
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(links)}
    ids = r.sample(range(10 * n), n)  # nodes in no order
    rows = [(ids[a], a, sizes[a], ids[b], b, sizes[b]) for a, b in pairs]
    df = spark.createDataFrame(rows, "i long, io long, n_i long, j long, jo long, n_j long").repartition(3)
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, []).append(b)
    want = [(i, j, ids[x], ids[y]) for i, j, x, y in people.replay_merges(sizes, edges)]
    got = sorted((x.step, x.met, x.source, x.target) for x in people._replay_rounds(df).collect())
    assert got == sorted(want)


def test_recluster(spark):
    v = clustered(4, 40)
    df = spark.createDataFrame([(k, k, f"p{k % 6}" if k % 4 == 0 else None, x.tolist()) for k, x in enumerate(v)], "id long, ord long, person string, vector array<float>")
    out, counts = people.recluster(df, 0.15)
    known = slow_assign(v, [f"p{k % 6}" if k % 4 == 0 else None for k in range(40)], 0.15, False)
    names = sorted({p for p in known if p}, key=lambda p: min(k for k in range(40) if known[k] == p))
    groups = {p: [v[k].astype(float) for k in range(40) if known[k] == p] for p in names}
    to = {}
    for a, b in slow_merges([np.mean(groups[p], axis=0) for p in names], [len(groups[p]) for p in names], 0.15):
        to[names[a]] = names[b]

    def final(p):
        while p in to:
            p = to[p]
        return p

    assert [r.person for r in out.orderBy("id").collect()] == [final(p) for p in known]
    c = counts.first()
    assert (c.attempted, c.assigned, c.merged) == (30, sum(known[k] is not None for k in range(40) if k % 4), len(to))


def test_merge_and_split_people(spark):
    faces = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "id long, person string")
    who = spark.createDataFrame([("a", "A", "o1"), ("b", "B", "o1"), ("z", "Z", "o2")], "id string, name string, org string")
    merges = spark.createDataFrame([("a", "b"), ("z", "b")], "source string, target string")
    f, p = people.merge_people(faces, who, merges)
    assert {tuple(r) for r in f.collect()} == {(1, "b"), (2, "b"), (3, "z"), (4, None)}
    assert {r.id for r in p.collect()} == {"b", "z"}
    f, p = people.split_person(faces, who, "a", spark.createDataFrame([(1,), (2,), (77,)], "id long"), "n")
    assert {tuple(r) for r in f.collect()} == {(1, "n"), (2, "b"), (3, "z"), (4, None)}
    assert ("n", "Unknown", "o1") in {tuple(r) for r in p.collect()}


def test_pointer_jumping(spark):
    n = 40
    df = spark.createDataFrame([(k, max(0, k - 1)) for k in range(n)] + [(100, 100)], "node long, parent long")
    assert {tuple(r) for r in rounds.roots(df).collect()} == {(k, 0) for k in range(n)} | {(100, 100)}


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def test_nearest_place_at_seams_and_poles(spark):
    r = random.Random(7)
    at = lambda: (r.choice([r.uniform(-90, 90), r.uniform(89, 90), r.uniform(-90, -89.4), r.uniform(-1, 1)]), r.choice([r.uniform(-180, 180), r.uniform(179.3, 180), r.uniform(-180, -179.3), r.uniform(-1, 1)]))
    points = [(k, *at()) for k in range(150)] + [(500, 0.0, 0.0), (501, None, 3.0), (502, 0.0, 0.2)]
    places = [(k, *at(), f"c{k}", "s", "k") for k in range(400)]
    out = {x.id: x.city for x in geo.nearest_place(spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(places, "pos long, lat double, lon double, city string, state string, country string")).collect()}
    hits = 0
    for i, a, b in points:
        near = min((km(a, b, p[1], p[2]), p[0]) for p in places) if a is not None and (a or b) else (99, None)
        want = f"c{near[1]}" if near[0] <= 50 else None
        hits += want is not None
        assert out[i] == want
    assert hits > 20


def test_geocode_literals(spark):
    places = spark.createDataFrame([(0, 48.8566, 2.3522, "Paris", "Île-de-France", "FR"), (1, 51.5074, -0.1278, "London", "England", "GB"), (2, 40.7128, -74.006, "New York", "New York", "US")], "pos long, lat double, lon double, city string, state string, country string")
    points = spark.createDataFrame([(1, 48.8566, 2.3522), (2, 51.5074, -0.1278), (3, 49.0, 2.0), (4, 30.0, -40.0)], "id long, latitude double, longitude double")
    assert {x.id: x.city for x in geo.nearest_place(points, places).collect()} == {1: "Paris", 2: "London", 3: "Paris", 4: None}
    assert {x.city for x in geo.nearest_place(points, places.limit(0)).collect()} == {None}


def box(*v):
    return dict(zip(("x1", "y1", "x2", "y2"), map(float, v), strict=True))


_B = "photo string, pos int, bbox struct<x1:double,y1:double,x2:double,y2:double>, score double"


def test_suppression(spark):
    r = random.Random(2)
    rows = [("a", 0, box(0, 0, 10, 10), 0.95), ("a", 1, box(1, 1, 11, 11), 0.7), ("b", 0, box(0, 0, 1, 1), 0.5)]
    rows += [("c", k, box(x := r.randrange(40), y := r.randrange(40), x + 15, y + 15), r.random()) for k in range(60)]
    out = boxes.suppress(spark.createDataFrame(rows, _B), 0.4).orderBy("photo", "rank").collect()

    def over(a, b):
        w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
        area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
        return w > 0 and h > 0 and w * h / (area(a) + area(b) - w * h) > 0.4

    for photo in "abc":
        kept = []
        for _, _, b, s in sorted((x for x in rows if x[0] == photo), key=lambda x: -x[3]):
            if not any(over(b, k) for k, _ in kept):
                kept.append((b, s))
        assert [(x.box.asDict(), x.score) for x in out if x.photo == photo] == kept


@pytest.mark.parametrize(("found", "want"), [([(0, 10, 50, 30), (52, 10, 100, 30)], [(0, 10, 100, 30)]), ([(0, 10, 50, 30), (200, 10, 250, 30)], None), ([(0, 0, 50, 20), (0, 100, 50, 120)], None), ([(5, 5, 6, 6)], None)])
def test_box_merge(spark, found, want):
    df = spark.createDataFrame([("a", k, box(*b), 1.0) for k, b in enumerate(found)], _B)
    assert [tuple(b) for b in boxes.merge_text_boxes(df).first().boxes] == [tuple(map(float, b)) for b in want or found]


def test_ctc(spark):
    hot = lambda c: [1.0 if k == c else 0.0 for k in range(40)]
    cases = {"": [hot(0)], "0": [hot(1)], "00": [hot(1), hot(0), hot(1)], "01": [hot(1), hot(2)], "z": [hot(36), hot(36)]}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [("", [])], "want string, steps array<array<double>>")
    assert all(r.want == r.got for r in df.withColumn("got", text.ctc_decode(F.col("steps"))).collect())


def test_hash_tokens(spark):
    df = spark.createDataFrame([("hello World",), ("",), (None,), ("a b c d e f",), ("漢" * 60,)], "t string")
    out = [r[0] for r in df.select(text.hash_tokens(F.col("t"), 4)).collect()]
    h = 0
    for c in "hello":
        h = h * 31 + ord(c)
    assert out[0][:2] == [49406, h % 49405 + 1] and out[0][3] == 49407
    assert out[1] == out[2] == [49406, 49407, 0, 0]
    assert all(len(x) == 4 for x in out)
    assert out[3][3] == 49407


def test_a_task_numbers_a_word_once(monkeypatch):
    seen, known = [], {}
    for words in (["a", "b", "a"], ["b", "c"], ["a"]):
        assert text._numbers(words, known, lambda w: seen.append(w) or ord(w)) == list(map(ord, words))
    assert seen == ["a", "b", "c"]
    assert text._numbers(["d"], known, ord, most=2) == [100] and known == {"d": 100}


@pytest.mark.parametrize("word", ["zzzzzzzzzzzzzzzz", "motorcyclemotorcycle", "漢字漢字漢字漢字漢字"])
def test_word_id_wraps_like_64_bits(word):
    h = 0
    for c in word:
        h = (h * 31 + ord(c) + (1 << 63)) % (1 << 64) - (1 << 63)
        h = -h if h < 0 else h
    assert text.word_id(word) == h % 49405 + 1


def test_unigram(spark):
    vocabulary = [("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), ("▁", -2.0), ("m", -5.0), ("▁motor", -3.0), ("cycle", -3.0), ("o", -4.0), ("▁mo", -2.5), ("tor", -2.0)]
    df = spark.createDataFrame([(1, "motorcycle", "x"), (2, "", "x"), (3, "Mo  q", "x"), (4, None, "x")], "id long, text string, other string")
    out = {r.id: r.tokens for r in text.unigram_tokens(df, vocabulary, 6).collect()}
    assert out[1] == [5, 6, 1, 0, 0, 0]
    assert out[2] == out[4] == [1, 0, 0, 0, 0, 0]
    assert out[3] == [8, 3, 3, 2, 1, 0]
    assert text.segment("xy", {}) == ["▁", "x", "y"]
    run = text.unigram_tokens(df, [*vocabulary, ("a▁b", -1.0)], 6)  # a piece that runs across words
    assert {r.id: r.tokens for r in run.collect()} == out


def test_unigram_moves_no_words(spark):
    vocabulary = [("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), ("▁", -2.0), ("a", -4.0)]
    df = spark.createDataFrame([(k, f"a b{k} a") for k in range(50)], "id long, text string")
    for known in (0, 3, 1000):  # of few words kept, and of all
        out = text.unigram_tokens(df, vocabulary, 8, known=known)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert {r.id: r.tokens for r in out.collect()}[7] == [3, 4, 3, 2, 2, 3, 4, 1]


def test_unigram_words_joined_back_by_position(spark):
    vocabulary = [("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), ("▁", -2.0), ("a", -4.0), ("▁a", -3.0), ("ab", -3.0)]
    r = random.Random(4)
    rows = [(k, None if k == 3 else " ".join(r.choice(["ab", "aab", "É", "", "baba", "A" * 40]) for _ in range(k))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    both = [sorted((x.id, x.window, tuple(x.tokens)) for x in text.unigram_tokens(df, vocabulary, 8, windows=True, known=known).collect()) for known in (0, 100)]
    assert both[0] == both[1] and len(both[0]) > 100
    scores, ids = dict(vocabulary), {w: n for n, (w, _) in enumerate(vocabulary)}
    for k, t in rows:
        want = [ids.get(p, 2) for w in (t.lower().split(" ") if t else []) for p in (text.segment(w, scores) if w else ["▁"])]
        own = [x for i, _, tokens in both[0] if i == k for x in tokens[: tokens.index(1)]]
        assert own == want
    one = [sorted((x.id, tuple(x.tokens)) for x in text.unigram_tokens(df, vocabulary, 8, known=known).collect()) for known in (0, 100)]
    assert one[0] == one[1] and len(one[0]) == 40


@pytest.mark.parametrize("seed", range(2))
def test_components_in_one_task_and_in_rounds(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long").repartition(3)
    root = {k: k for p in pairs for k in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if k != v}
    assert {x.u: x.root for x in rounds.components(df).collect()} == want
    assert {x.u: x.root for x in rounds.components(df, 0).collect()} == want
    assert rounds.components(df.limit(0)).count() == 0


def test_rows_of_a_threshold_join_are_sent_to_few_blocks(spark):
    """Blocks grow with the table, and hold many tiles: what moves no longer grows with the square of the rows."""
    df = spark.range(20_000).select("id", F.array(*[F.randn(k) for k in range(4)]).alias("vector"))
    assert vectors._blocks(df, None, None, (), 0.7).count() <= 15 * 20_000  # each to each of 20 pivots' blocks before
    v = np.random.default_rng(6).normal(size=(300, 4))
    rows = spark.createDataFrame([(k, x.tolist(), k % 3 == 0, k if k % 2 else None) for k, x in enumerate(v)], "id long, vector array<double>, asks boolean, low long")
    want = {a: min(b for b in range(1, 300, 2) if b != a and cosine(v[a], v[b]) < 0.7) for a in range(0, 300, 3)}
    assert {r.id: r.offer for r in vectors.least_offers(rows, 0.7, 40).collect()} == want


def test_scores_are_held_for_few_queries_at_a_time():
    """The search for the best rows of 3,000 queries among 2,048: their scores and copies of them took some 300 MB before."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(7)
    queries, m = r.normal(size=(3000, 8)), r.normal(size=(2048, 8))
    best = vectors.Best(queries, 5)
    tracemalloc.start()
    best.see(np.arange(2048), pa.array(m.tolist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    u = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries, m)]
    assert (best.ids == np.argsort(-(u[0] @ u[1].T), axis=1)[:, :5]).all()


def test_words_of_a_text_are_found_once_for_all_windows(spark):
    df = spark.createDataFrame([("a b  c\td e",), ("",), (None,)], "t string")
    out = df.select(text.word_windows(F.col("t"), 2).alias("w"))
    assert [r.w for r in out.collect()] == [["a b", "c d", "e"], [""], [""]]
    long = spark.range(1).select(F.repeat(F.lit("word "), 150_000).alias("t"))
    began = time.time()
    assert long.select(F.size(text.word_windows(F.col("t"), 75))).first()[0] == 2000
    assert time.time() - began < 20
