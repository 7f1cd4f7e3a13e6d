"""Queries of vector search, near-duplicates and people, over `embeddings`, `part` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import enrich, library, people, similarity, text, vectors
from ..operators.rounds import materialise
from .base import Plans, table

PLANS = Plans()
TAU = 0.7
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"""
    SELECT query, id, round(score, 6) AS score, rank FROM (
        SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS score,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 12) DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10"""


@PLANS.add(_KNN)
def knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn(e.where("vec_id % 50 = 0"), e, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"""
    SELECT x.vec_id AS id, x.class_id, x.copies - 1 + coalesce(y.n, 0) AS n_links FROM (
        SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS class_id, count(*) OVER (PARTITION BY embedding) AS copies FROM embeddings) x
    LEFT JOIN (SELECT a.vec_id, count(*) AS n FROM embeddings a, embeddings b
        WHERE a.embedding <> b.embedding AND 1 - {_COS} < {TAU} GROUP BY ALL) y ON x.vec_id = y.vec_id""")
def vector_threshold_join(spark, sf_dir):
    return vectors.link_counts(table(spark, sf_dir, "embeddings"), TAU)


@PLANS.add("""
    SELECT label, pos, n, round(mean, 6) AS mean FROM (
        SELECT label, pos - 1 AS pos, avg(x::DOUBLE) AS mean, count(*) AS n FROM (
            SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL)""")
def label_centroids(spark, sf_dir):
    c = vectors.centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), "n", F.round("mean", 6).alias("mean"))


@PLANS.add("SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) > 0 GROUP BY label")
def vector_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.usable(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("label").agg(F.count("*").alias("n"))


@PLANS.add()
def ivf_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    centres = vectors.fit_lists(e, max(4, int(e.count() ** 0.5)))
    found = vectors.ivf_search(e.where("vec_id % 50 = 0"), e, centres, vectors.pick_probes(e, centres, 10), 10)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


def _hashed_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    digit = F.element_at(F.array(*map(F.lit, "013")), (F.col("p_partkey") % 3).cast("int") + 1)
    text_hash = F.concat(F.lit("p:"), F.substring(F.md5(F.expr("p_partkey div 3").cast("string").cast("binary")), 1, 15), digit)
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), text_hash.alias("perceptual_hash"))


_DIGIT = "[0, 1, 3][({0} % 3 + 1)::INT]"


@PLANS.add(f"""
    SELECT p_partkey AS id, g.leader_id, p_partkey = g.leader_id AS leads, g.n AS group_size,
           bit_count(xor({_DIGIT.format('g.leader_id')}, {_DIGIT.format('g.last_id')}))::INT AS distance
    FROM part JOIN (SELECT p_partkey // 3 AS grp, min(p_partkey) AS leader_id, max(p_partkey) AS last_id, count(*) AS n
        FROM part GROUP BY ALL HAVING count(*) > 1) g ON p_partkey // 3 = g.grp""")
def near_dup_groups(spark, sf_dir):
    return similarity.duplicate_groups(_hashed_parts(spark, sf_dir), 5, scope=None)


@PLANS.add("SELECT min(p_partkey) AS id FROM part GROUP BY p_partkey // 3")
def remove_duplicates(spark, sf_dir):
    media = _hashed_parts(spark, sf_dir)
    return similarity.without_duplicates(media, similarity.duplicate_groups(media, 5, scope=None)).select("id")


def _faces(spark, sf_dir):
    """Vectors as faces in the order of vec_id; every tenth is already its label's."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.when(F.col("vec_id") % 10 == 0, F.concat(F.lit("p"), F.col("label"))).alias("person"), F.col("embedding").alias("vector"))


_PAIRS = f"""
    f AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'p' || label END AS person FROM embeddings),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - {_COS} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND 1 - {_COS} < {TAU})"""
_ROOTS = """
    p AS (SELECT f.id, coalesce(arg_min(d.b, [d.d, d.b::DOUBLE]) FILTER (o.id IS NOT NULL), f.id) AS parent
          FROM f LEFT JOIN d ON d.a = f.id LEFT JOIN {among} o ON o.id = d.b AND (o.person IS NOT NULL OR o.id < f.id)
          WHERE f.person IS NULL AND f.id IN (SELECT id FROM {among}) GROUP BY f.id
          UNION ALL SELECT id, id FROM f WHERE person IS NOT NULL),
    t AS (SELECT id, parent FROM p UNION SELECT t.id, p.parent FROM t JOIN p ON t.parent = p.id),
    r AS (SELECT t.id, t.parent AS root FROM t JOIN p ON t.parent = p.id AND p.parent = p.id)"""


@PLANS.add(f"""
    WITH RECURSIVE {_PAIRS}, {_ROOTS.format(among='f')}
    SELECT r.id, coalesce(f.person, 'new:' || r.root) AS person FROM r JOIN f ON f.id = r.root""")
def assign_new_people(spark, sf_dir):
    return people.assign_faces(_faces(spark, sf_dir), TAU).select("id", "person")


_KNOWN = f"""
    WITH RECURSIVE {_PAIRS},
    e AS (SELECT id, person FROM f WHERE person IS NOT NULL
          UNION SELECT d.b, f.person FROM e JOIN d ON d.a = e.id JOIN f ON f.id = d.b WHERE f.person IS NULL AND (e.person IS NOT NULL OR e.id < d.b)),
    {_ROOTS.format(among='e')},
    known AS (SELECT f.id, g.person FROM f LEFT JOIN r ON r.id = f.id LEFT JOIN f g ON g.id = r.root)"""


@PLANS.add(f"{_KNOWN} SELECT id, person FROM known")
def assign_existing_people(spark, sf_dir):
    return people.assign_known(_faces(spark, sf_dir), TAU).select("id", "person")


_SET = "list_transform({0}, lambda x, k: CASE WHEN k = {1} THEN {2} ELSE x END)"


@PLANS.add(f"""{_KNOWN},
    mean AS (SELECT person, pos, avg(x) AS x, count(*) AS n FROM (SELECT person, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM known JOIN embeddings ON vec_id = id WHERE person IS NOT NULL) GROUP BY 1, 2),
    who AS (SELECT row_number() OVER (ORDER BY first) AS i, * FROM (SELECT person, max(n) AS n, list(x ORDER BY pos) AS v FROM mean GROUP BY 1) JOIN (SELECT person, min(id) AS first FROM known GROUP BY 1) USING (person)),
    near AS (SELECT list(1 - list_cosine_similarity(a.v, b.v) < {TAU} ORDER BY a.i, b.i) AS near, sqrt(count(*))::BIGINT AS most FROM who a, who b),
    step AS (SELECT 1::BIGINT AS i, 2::BIGINT AS j, list(who.i ORDER BY who.i) AS name, list(n ORDER BY who.i) AS size, list(who.i ORDER BY who.i) AS target FROM who
        UNION ALL SELECT CASE WHEN j >= most THEN i + 1 ELSE i END, CASE WHEN j >= most THEN i + 2 ELSE j + 1 END,
            CASE WHEN hit THEN {_SET.format('name', 'i', 'new')} ELSE name END, CASE WHEN hit THEN {_SET.format('size', 'i', 'size[i] + size[j]')} ELSE size END, CASE WHEN hit THEN {_SET.format('target', 'old', 'new')} ELSE target END FROM (
            SELECT *, CASE WHEN size[j] > size[i] THEN name[i] ELSE name[j] END AS old, CASE WHEN size[j] > size[i] THEN name[j] ELSE name[i] END AS new,
                near[(i - 1) * most + j] AND target[name[i]] = name[i] AND target[name[j]] = name[j] AS hit FROM step, near WHERE i < most)),
    done AS (SELECT target FROM step ORDER BY i DESC, j DESC LIMIT 1),
    chain AS (SELECT who.i, who.i AS top FROM who UNION SELECT chain.i, target[top] FROM chain, done),
    final AS (SELECT a.person, b.person AS other FROM chain JOIN done ON target[top] = top JOIN who a ON a.i = chain.i JOIN who b ON b.i = top)
    SELECT known.id, known.id AS ord, final.other AS person FROM known LEFT JOIN final USING (person)""")
def recluster(spark, sf_dir):
    return people.recluster(_faces(spark, sf_dir), TAU)[0]


def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    faces = e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("person"))
    return faces, faces.groupBy(F.col("person").alias("id")).agg(F.lit("Unknown").alias("name"), F.lit("o").alias("org"))


@PLANS.add("SELECT vec_id AS id, label::BIGINT - label % 3 AS person FROM embeddings")
def merge_people(spark, sf_dir):
    faces, who = _labelled(spark, sf_dir)
    merges = who.where("id % 3 <> 0").select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    return people.merge_people(faces, who, merges)[0]


@PLANS.add("SELECT vec_id AS id, CASE WHEN label = 0 AND vec_id % 2 = 0 THEN -1 ELSE label END::BIGINT AS person FROM embeddings")
def split_person(spark, sf_dir):
    faces, who = _labelled(spark, sf_dir)
    return people.split_person(faces, who, 0, faces.where("id % 2 = 0"), -1)[0]


@PLANS.add("""
    SELECT s_suppkey AS id, count(DISTINCT l_partkey) AS photo_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def media_per_person(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("photo"))
    return people.media_per_person(faces, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@PLANS.add("""
    SELECT p_partkey AS id FROM part WHERE p_size % 10 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)""")
def person_media(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("photo"))
    media = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 == 0, F.current_timestamp()).alias("trashed_at"))
    return people.person_media(faces, media, 1).select("id")


@PLANS.add("""
    SELECT s_suppkey AS id, t.l_orderkey AS thumbnail_photo_id, o_orderpriority AS thumbnail_photo_file FROM supplier
    LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS face, l_orderkey FROM lineitem) t ON t.face = s_suppkey * 11
    LEFT JOIN orders ON o_orderkey = t.l_orderkey WHERE s_suppkey % 5 <> 0""")
def people_thumbnails(spark, sf_dir):
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5 == 0).alias("is_hidden"), (F.col("s_suppkey") * 11).alias("thumbnail_face"))
    faces = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("photo"))
    media = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file"), F.lit("").alias("thumbnail"))
    return people.people_with_thumbnails(who, faces, media).select("id", "thumbnail_photo_id", "thumbnail_photo_file")


@PLANS.add("""
    WITH lib AS (SELECT doc_id AS id, lower(source) || ' ' || lower(text) AS t FROM documents),
    near AS (SELECT b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0
             ORDER BY round(score, 12) DESC, b.vec_id LIMIT 20)
    SELECT lib.id, 0 AS slot, round(score, 6) AS score FROM lib JOIN near ON lib.id = near.id
    UNION ALL SELECT id, 1, NULL FROM lib WHERE t LIKE '%license%' AND id NOT IN (SELECT id FROM near)""")
def hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lib = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("description"), F.timestamp_seconds(F.col("doc_id")).alias("taken_at"))
    e = table(spark, sf_dir, "embeddings")
    near = vectors.knn(e.where("vec_id = 0"), e, 20).select("id", "score")
    hits = lib.where(library.matches_text(" License ", "name", "description"))
    found = library.hybrid(lib.drop("description"), near, hits.drop("description"))
    return found.select("id", "slot", F.round("score", 6).alias("score"))


@PLANS.add("""
    WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM documents),
    h AS (SELECT w, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h FROM (SELECT DISTINCT w FROM w)),
    c AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w JOIN h USING (w) GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
    v AS (SELECT d.doc_id, d.blank, list(coalesce(CASE WHEN n > 0 THEN x / n ELSE x END, 0)::FLOAT::DOUBLE ORDER BY d.i) AS v
        FROM (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, unnest(range(64)) AS i FROM documents) d LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = d.i LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2),
    s AS (SELECT a.doc_id AS query, b.doc_id AS id, CASE WHEN list_sum(list_transform(a.v, lambda x: abs(x))) = 0 OR list_sum(list_transform(b.v, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END AS score FROM v a, v b WHERE a.doc_id % 50 = 0 AND NOT a.blank)
    SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def encode_search(spark, sf_dir):
    from ..operators.search import semantic_search

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    corpus = enrich.encode(docs, enrich.hashing_encoder(64), "text").select(F.col("doc_id").alias("vec_id"), "embedding")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "text")
    return semantic_search(asked, corpus, enrich.hashing_encoder(64), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


# A fixed small vocabulary: single letters and some pieces, with log scores.
VOCABULARY = [("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0)] + [(c, -6.0) for c in "abcdefghijklmnopqrstuvwxyz"] + [("▁", -3.0), ("▁the", -3.5), ("▁and", -4.0), ("tion", -4.0), ("ing", -4.0), ("er", -4.2), ("▁de", -4.1), ("en", -4.3)]


_VOCABULARY = ", ".join(f"{token!r}: {score!r}::DOUBLE" for token, score in VOCABULARY)
_IDS = ", ".join(f"{token!r}: {k}" for k, (token, _) in enumerate(VOCABULARY))


@PLANS.add(f"""
    WITH RECURSIVE voc AS (SELECT MAP {{{_VOCABULARY}}} AS m, MAP {{{_IDS}}} AS ids),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents WHERE coalesce(text, '') <> '')),
    r AS (SELECT w, '▁' || w AS t, 0 AS e, [0.0::DOUBLE] AS best, [0::BIGINT] AS via FROM (SELECT DISTINCT w FROM w)
        UNION ALL SELECT w, t, e + 1, list_append(best, CASE WHEN len(c) = 0 THEN best[-1] + {text.FALLBACK!r}::DOUBLE ELSE c[1].s END), list_append(via, CASE WHEN len(c) = 0 THEN 1 ELSE c[1].z END) FROM (
            SELECT r.*, list_reverse_sort(list_transform(list_filter(range(1, least(e + 1, 4) + 1), lambda z: m[substr(t, e + 2 - z, z)] IS NOT NULL), lambda z: {{'s': best[e + 2 - z] + m[substr(t, e + 2 - z, z)], 'z': z}})) AS c
            FROM r, voc WHERE e < length(t))),
    b AS (SELECT w, t, via, e::BIGINT AS e, []::VARCHAR[] AS pieces FROM r WHERE e = length(t)
        UNION ALL SELECT w, t, via, e - via[e + 1], list_prepend(substr(t, e - via[e + 1] + 1, via[e + 1]), pieces) FROM b WHERE e > 0),
    g AS (SELECT w, list_transform(pieces, lambda x: coalesce(ids[x], 2)) AS own FROM b, voc WHERE e = 0),
    n AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) - 1 AS k FROM (SELECT doc_id, p, unnest(own) AS id, unnest(range(len(own))) AS q FROM w JOIN g USING (w)))
    SELECT doc_id, k // 63 AS "window", string_agg(id::VARCHAR, ' ' ORDER BY k) || ' 1' || repeat(' 0', (63 - count(*))::INT) AS tokens FROM n GROUP BY doc_id, k // 63
    UNION ALL SELECT doc_id, 0, '1' || repeat(' 0', 63) FROM documents WHERE coalesce(text, '') = ''""")
def unigram_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.unigram_tokens(docs, VOCABULARY, 64, windows=True).select("doc_id", "window", F.array_join("tokens", " ").alias("tokens"))


_WRAP = "(({0} + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)"


@PLANS.add(f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    v AS (SELECT doc_id, k, w[75 * k + 1 : 75 * k + 75] AS own FROM (SELECT *, unnest(range(greatest(1, (len(w) + 74) // 75))) AS k FROM w)),
    d AS (SELECT DISTINCT unnest(w) AS word FROM w),
    h AS (SELECT word, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(word, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: abs({_WRAP.format('(a * 31 + c)')})) % 49405 + 1 AS id FROM d),
    u AS (SELECT doc_id, k, unnest(own) AS word, unnest(range(len(own))) AS p FROM v),
    i AS (SELECT doc_id, k, string_agg(id::VARCHAR, ' ' ORDER BY p) AS ids, count(*) AS n FROM u JOIN h USING (word) GROUP BY doc_id, k)
    SELECT v.doc_id, v.k AS "window", '49406' || coalesce(' ' || ids, '') || ' 49407' || repeat(' 0', (75 - coalesce(n, 0))::INT) AS tokens FROM v LEFT JOIN i USING (doc_id, k)""")
def hash_tokens(spark, sf_dir):
    """Windows of 75 words, so that every word of a text has its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_windows(F.col("text"), 75)).alias("window", "own"))
    return docs.select("doc_id", F.col("window").cast("long").alias("window"), F.array_join(text.hash_tokens(F.col("own"), 77), " ").alias("tokens"))


_BEST = "list_position(list_slice(embedding, {0}, {1}), list_max(list_slice(embedding, {0}, {1}))) - 1"
_CHAR = f"substr('{text.CHARSET}', {{0}}::INT, 1)"


@PLANS.add(f"""
    SELECT vec_id, CASE WHEN a > 0 THEN {_CHAR.format('a')} ELSE '' END || CASE WHEN b > 0 AND b <> a THEN {_CHAR.format('b')} ELSE '' END AS text
    FROM (SELECT vec_id, {_BEST.format(1, 37)} AS a, {_BEST.format(28, 64)} AS b FROM embeddings)""")
def ctc_decode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    steps = F.array(F.slice("embedding", 1, 37), F.slice("embedding", 28, 37))
    return materialise(e.select("vec_id", text.ctc_decode(steps).alias("text")))


@PLANS.add(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity, round(1 - {_COS}, 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(S.cosine_similarity(F.col("x"), F.col("y")), 6).alias("similarity"), F.round(S.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))
