"""The pipeline's stages and run() against brute-force versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash

import corpus_pipeline as P
from shoebox.llm import jaccard, quality_classifier
from shoebox.llm.common import held_out

from .test_llm_documents import linked, normal, prose, slow_cut
from .test_near_copies import changed

SCHEMA = "doc_id long, text string, n_chars int, label string, key string, _k map<string,int>"


def rows():
    good = [prose(k, 120 + k) for k in range(40)]
    out = [(100 + k, t) for k, t in enumerate(good)]
    out += [(200 + k, " ".join(w + "###" for w in prose(900 + k, 80).split())) for k in range(40)]  # what labels call bad
    out += [(300 + k, good[k].replace(" ", "  ")) for k in range(6)] + [(None, good[7]), (None, good[8] + " "), (None, None), (None, "")]
    out += [(400 + k, changed(good[10 + k], k, 2)) for k in range(8)] + [(None, changed(good[20], 5, 2))]
    out += [(500 + k, prose(70 + k, 60) + " " + " ".join(good[30].split()[20:80]) + " " + prose(80 + k, 60)) for k in range(5)]
    out += [(5, "tiny"), (101, good[1]), (101, prose(3333, 150)), (600, prose(5555, 6000)), (601, None)]
    return [(i, t, len(t or ""), "x", "y", {"a": 1}) for i, t in out]


def labels():
    return [(100 + k, 1, 0) for k in range(40)] + [(200 + k, 0, 0) for k in range(40)] + [(5, None, 0), (None, 1, 0)]


def slow_quality(spark, data):
    docs = spark.createDataFrame(data, SCHEMA)
    known = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").selectExpr("doc_id", "double(quality) label")
    model = quality_classifier.fit(quality_classifier.statistics(docs).where(~held_out(3, 1)).join(known, "doc_id"))
    assert model.rules
    classes = quality_classifier._byte_classes()

    def good(text):
        x = dict(zip(quality_classifier.FEATURES, quality_classifier.text_features((text or "").encode(), classes), strict=True))
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(x[f] <= t if at_most else x[f] > t for f, at_most, t in rule.tests))
        return 1 / (1 + math.exp(-z)) >= 0.5

    return [r for r in data if good(r[1])]


def first(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0))


def slow_exact(data):
    groups = defaultdict(list)
    for r in data:
        groups[normal(r[1])].append(r)
    return [first(g) for g in groups.values()]


def slow_near(data):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(r[1]) for r in data]
    root = linked(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    groups = defaultdict(list)
    for k, r in enumerate(data):
        groups[root[k]].append(r)
    return [first(g) for g in groups.values()]


def slow_passages(data):
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    cut = slow_cut([(r[1] or "").encode() for r in order])
    return [(r[0], x[3].decode("utf-8", "ignore"), len(x[3].decode("utf-8", "ignore"))) if x[1] else r[:3] for r, x in zip(order, cut, strict=True)]


def slow_pieces(data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in data]
    return Counter((i, s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 2048))


def same(df, want):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in df.collect()) == Counter(r[:3] for r in want)


def test_stages_and_run(spark, tmp_path):
    data, folder = rows(), str(tmp_path)
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = lambda x: spark.createDataFrame([r if len(r) > 3 else (*r, "x", "y", {"a": 1}) for r in x], SCHEMA).repartition(3)
    good = slow_quality(spark, data)
    assert 40 <= len(good) < len(data) - 30
    same(P.quality(spark, df(data), folder), good)
    once = slow_exact(good)
    assert len(once) < len(good) - 5
    same(P.exact_copies(spark, df(good), folder), once)
    apart = slow_near(once)
    assert len(apart) < len(once) - 5
    same(P.near_copies(spark, df(once), folder), apart)
    cut = slow_passages(apart)
    assert Counter(r[:3] for r in cut) != Counter(r[:3] for r in apart)
    same(P.repeated_passages(spark, df(apart), folder), cut)
    out = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == slow_pieces(cut)
    assert {r.sequence_id for r in out} == set(range(max(r.sequence_id for r in out) + 1))


def test_every_stage_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame(labels()[:0] or [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_repeated_rows_keep_their_texts(spark, tmp_path):
    text = prose(1, 100)
    docs = spark.createDataFrame([(1, text, 0, "x", "y", {"a": 1})] * 2 + [(2, text + " more", 0, "x", "y", {"a": 1})], SCHEMA)
    out = sorted((r.doc_id, r.text) for r in P.repeated_passages(spark, docs, str(tmp_path)).collect())
    assert out[:2] == [(1, text), (1, text)]
    assert len(out[2][1]) < 110


def test_confirmation_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert jaccard.similar(a[:4], a[:5]) and not jaccard.similar(a[:4], a[[0, 1, 2, 3, 5, 6]])
