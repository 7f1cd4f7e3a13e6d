"""Queries of sources and sinks: files that Spark writes from the tables into the shared folder, and reads again."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import library, similarity
from ..operators.rounds import shared_folder
from ..sources import exif, heads, readers
from .base import Plans, table

PLANS = Plans()


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@PLANS.add("""
    SELECT 'Place ' || c_custkey AS city, 'S' || c_nationkey AS state, c_mktsegment AS country, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey / 8.0 END::DOUBLE AS lat, -(c_nationkey / 4.0)::DOUBLE AS lon
    FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND NOT (c_custkey % 5 = 0 AND c_nationkey = 0)""")
def gazetteer(spark, sf_dir):
    """Customers as lines of a gazetteer: some too short, some without a name, some with a latitude that is no plain decimal."""
    c = table(spark, sf_dir, "customer")
    lat = F.when(F.col("c_custkey") % 5 == 0, "1e5").otherwise((F.col("c_custkey") / 8).cast("string"))
    fields = [F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("Place "), "c_custkey")), F.lit(""), F.lit(""), lat, (-F.col("c_nationkey") / 4).cast("string"), F.lit("P"), F.lit("PPL"), F.col("c_mktsegment"), F.lit(""), F.concat(F.lit("S"), "c_nationkey"), *[F.lit("")] * 6]
    short = F.concat_ws("\t", *fields[:10])
    path = _folder(spark, "gazetteer")
    c.select(F.when(F.col("c_custkey") % 11 == 0, short).otherwise(F.concat_ws("\t", *fields))).write.option("compression", "gzip").text(path)
    return readers.read_gazetteer(spark, path).select("city", "state", "country", "lat", "lon")


_TEXTS = "['', '.5', '12.', '1e5', '-', l_partkey || '.25', '-' || l_suppkey, ' 7', 'x'][(l_linenumber % 9 + 1)::INT]"


@PLANS.add(f"""
    SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN regexp_full_match(t, '-?[0-9]*\\.?[0-9]*') THEN coalesce(TRY_CAST(t AS DOUBLE), 0) ELSE 0 END AS number FROM (SELECT *, {_TEXTS} AS t FROM lineitem)""")
def scalar_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    texts = F.array(F.lit(""), F.lit(".5"), F.lit("12."), F.lit("1e5"), F.lit("-"), F.concat("l_partkey", F.lit(".25")), F.concat(F.lit("-"), "l_suppkey"), F.lit(" 7"), F.lit("x"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), S.lenient_number(F.element_at(texts, (F.col("l_linenumber") % 9 + 1).cast("int"))).alias("number"))


@PLANS.add("SELECT p_partkey AS id, p_size % 4 = 1 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS has_camera FROM part")
def camera_predicate(spark, sf_dir):
    make = F.when(F.col("p_size") % 4 == 1, F.col("p_brand")).when(F.col("p_size") % 4 == 2, "")
    iso = F.when(F.col("p_partkey") % 3 == 0, 100).when(F.col("p_partkey") % 3 == 1, 0)
    lens = F.when(F.col("p_partkey") % 5 == 0, "35mm").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.has_camera_data(make, iso, lens).alias("has_camera"))


@PLANS.add("""
    SELECT s_suppkey AS org, CASE WHEN s_suppkey % 6 = 0 THEN false ELSE true END AS ocr_enabled, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN s_nationkey / 100.0 ELSE 0.7 END::DOUBLE AS min_face_score, 0.6::DOUBLE AS max_face_distance,
        CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 3 END::BIGINT AS min_faces, 30 AS poll_interval_secs, 8 AS batch_size FROM supplier""")
def org_settings(spark, sf_dir):
    """Half the orgs have settings, some of them with values unset; all orgs get the defaults for the rest."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org"), "s_nationkey")
    own = s.where("org % 2 = 0").select("org", F.when(F.col("org") % 3 == 0, F.lit(False)).alias("ocr_enabled"), F.when(F.col("org") % 4 != 0, F.col("s_nationkey") / 100.0).alias("min_face_score"), F.col("s_nationkey").cast("long").alias("min_faces"))
    return library.settings_of(s.select("org"), own)


@PLANS.add("""
    SELECT row_number() OVER (ORDER BY t) - 1 AS id, t AS token, -round(length(t) / 4.0, 2)::DOUBLE AS score, 7 AS end_id FROM (SELECT DISTINCT p_type || '▁' || p_size AS t FROM part)""")
def vocabulary_file(spark, sf_dir):
    """The distinct types of parts as a tokenizer's vocabulary (a model's list, one file), written and read again."""
    tokens = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("▁"), F.col("p_size").cast("string")).alias("t")).distinct()
    tokens = tokens.agg(F.sort_array(F.collect_list("t")).alias("v"))
    pair = lambda t: F.concat(F.lit('["'), t, F.lit('",'), (-F.round(F.length(t) / 4, 2)).cast("string"), F.lit("]"))
    path = _folder(spark, "vocabulary")
    tokens.select(F.concat(F.lit('{"model":{"vocab":['), F.array_join(F.transform("v", pair), ",\n"), F.lit(']},"added_tokens":[{"id":7,"content":"</s>"},{"id":3,"content":"<pad>"}]}'))).coalesce(1).write.text(path)
    rows, end = readers.read_vocabulary(spark, path)
    return rows.select(F.col("id").cast("long").alias("id"), "token", "score", F.lit(end).alias("end_id"))


@PLANS.add("SELECT sum(2 * octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, 0::BIGINT AS wrong, 1::BIGINT AS missing FROM documents")
def media_content(spark, sf_dir):
    """Texts written as files; the files' rows (and one that has no file) meet their bytes again."""
    path = _folder(spark, "content")
    table(spark, sf_dir, "documents").select(F.hex(F.coalesce("text", F.lit("")).cast("binary")).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), (F.octet_length("value") + 1).cast("long").alias("n"))
    rows = lines.groupBy("file").agg(F.sum("n").alias("n")).union(spark.range(1).select(F.lit("no such file"), F.col("id")))
    found = readers.with_parts(rows, spark, path, pattern="*.txt").groupBy("file", "n").agg(F.sum(F.octet_length("content")).alias("own"))
    return found.agg(F.sum("own").cast("long").alias("n_bytes"), F.count_if(F.col("own") != F.col("n")).alias("wrong"), F.count_if(F.col("own").isNull()).alias("missing"))


@PLANS.add("SELECT user_id % 7 AS org, count(*) AS n, max(event_id) AS newest, round(sum(value), 4) AS total FROM events GROUP BY 1")
def saved_rows(spark, sf_dir):
    """Two appends to a table that is partitioned by org, read again."""
    e = table(spark, sf_dir, "events").withColumn("org", F.col("user_id") % 7)
    path = _folder(spark, "saved")
    readers.write_table(e.where("event_id % 3 = 0"), path)
    readers.write_table(e.where("event_id % 3 <> 0"), path)
    saved = spark.read.parquet(path)
    return saved.groupBy(F.col("org").cast("long").alias("org")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"), F.round(F.sum("value"), 4).alias("total"))


def _le(x: Column | int, size: int) -> Column:
    """A number's little-endian bytes in hex."""
    h = F.lpad(F.hex(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * (size - k) - 1, 2) for k in range(size)])


def _entry(tag: int, kind: int, n: int, value: Column | int) -> Column:
    return F.concat(_le(tag, 2), _le(kind, 2), _le(n, 4), _le(value, 4))


def _ascii(text: Column, size: int) -> Column:
    return F.rpad(F.hex(text.cast("binary")), 2 * size, "0")


def _jpeg(make: Column, iso: Column, taken: Column, eighths: Column, south: Column) -> Column:
    """A JPEG's first bytes with camera metadata: offsets count from the TIFF header."""
    top, sub, gps = 8, 50, 92
    data = 146  # where the values begin: make (24), time (20), aperture (8), latitude (24), longitude (24)
    parts = [
        F.lit("49492A00"), _le(top, 4), _le(3, 2), _entry(0x010F, 2, 24, data), _entry(0x8769, 4, 1, sub), _entry(0x8825, 4, 1, gps), _le(0, 4),
        _le(3, 2), _entry(0x8827, 3, 1, iso), _entry(0x829D, 5, 1, data + 44), _entry(0x9003, 2, 20, data + 24), _le(0, 4),
        _le(4, 2), _entry(1, 2, 2, F.when(south, 0x53).otherwise(0x4E)), _entry(2, 5, 3, data + 52), _entry(3, 2, 2, 0x45), _entry(4, 5, 3, data + 76), _le(0, 4),
        _ascii(make, 24), _ascii(taken, 20), _le(28, 4), _le(10, 4), _le(eighths, 4), _le(8, 4), *[_le(k, 4) for k in (0, 1, 0, 1, 7, 1, 30, 1, 0, 1)],
    ]
    return F.unhex(F.concat(F.lit("FFD8FFE1"), F.lit("00FF"), F.lit("457869660000"), *parts, F.lit("FFD9")))


@PLANS.add("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS camera_make, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 6400 END AS iso, CASE WHEN o_orderkey % 9 <> 0 THEN 'f/2.8' END AS aperture,
        CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' END AS taken, CASE WHEN o_orderkey % 9 <> 0 THEN ((o_orderkey % 700 + 1) / 8.0 * CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END)::DOUBLE END AS latitude,
        CASE WHEN o_orderkey % 9 <> 0 THEN 7.5::DOUBLE END AS longitude FROM orders""")
def camera_metadata(spark, sf_dir):
    """Orders as JPEG bytes, some of them without metadata."""
    o = table(spark, sf_dir, "orders")
    bytes_ = _jpeg(F.col("o_orderpriority"), F.col("o_custkey") % 6400, F.date_format("o_orderdate", "yyyy:MM:dd 10:20:30"), F.col("o_orderkey") % 700 + 1, F.col("o_custkey") % 2 == 0)
    files = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, bytes_).otherwise(F.unhex(F.lit("FFD8FFD9"))).alias("content"))
    found = exif.extract_exif(files)
    return found.select("id", "camera_make", "iso", "aperture", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken"), "latitude", "longitude")


#: How much the pixels of row (or column) p of an 8 x 8 picture, drawn out to 64 x 64, weigh in frequency f: number 8 f + p.
_WEIGHTS = [sum(round(similarity.COSINE * math.cos(math.pi * (2 * n + 1) * f / 128)) for n in range(64) if round(n / 9) == p) for f in range(8) for p in range(8)]


@PLANS.add(f"""
    WITH b AS (SELECT unnest({_WEIGHTS!r}::BIGINT[]) AS w, unnest(range(64)) AS i),
    px AS (SELECT vec_id, k, least(greatest(round(x::DOUBLE * 100 + 128), 0), 255)::BIGINT AS v FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings WHERE vec_id % 4 <> 3)),
    r AS (SELECT vec_id, b.i // 8 AS f, k % 8 AS q, sum(w * v)::BIGINT AS s FROM px JOIN b ON b.i % 8 = k // 8 GROUP BY ALL),
    c AS (SELECT vec_id, f, b.i // 8 AS g, sum(s * w)::BIGINT::DOUBLE AS c FROM r JOIN b ON b.i % 8 = q GROUP BY ALL),
    h AS (SELECT vec_id, 8 * (f % 4) + g AS k, f // 4 AS half, c > median(c) OVER (PARTITION BY vec_id) AS bit FROM c),
    n AS (SELECT vec_id, sum(CASE WHEN bit AND half = 0 THEN 1::BIGINT << (31 - k)::INT ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN bit AND half = 1 THEN 1::BIGINT << (31 - k)::INT ELSE 0 END)::BIGINT AS lo FROM h GROUP BY vec_id)
    SELECT e.vec_id AS id, 'p:' || printf('%08x', hi) || printf('%08x', lo) AS perceptual_hash, CASE WHEN e.vec_id % 4 = 3 THEN 'undecodable' END AS error FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id""")
def pixel_hashes(spark, sf_dir):
    """Vectors as grey images of 8 x 8 pixels; every fourth has no pixels."""
    e = table(spark, sf_dir, "embeddings")
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.round(x * 100 + 128), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    data = F.when(F.col("vec_id") % 4 != 3, F.unhex(F.array_join(pixel, "")))
    image = F.struct(F.col("vec_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return similarity.hash_images(e.select(image.alias("image"))).select(F.col("path").cast("long").alias("id"), "perceptual_hash", "error")


@PLANS.add("""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS camera_make, CASE WHEN c_custkey % 9 <> 0 THEN (c_nationkey * 100 + 100) % 6400 END AS iso,
        CASE WHEN c_custkey % 9 <> 0 THEN '2024-05-06 07:08:09' END AS taken, CASE WHEN c_custkey % 9 <> 0 THEN ((c_custkey % 700 + 1) / 8.0 * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END)::DOUBLE END AS latitude,
        (CASE WHEN c_custkey % 9 <> 0 THEN 260 ELSE 4 END + CASE WHEN c_custkey % 100 = 0 THEN 200000 ELSE 0 END)::BIGINT AS bytes FROM customer""")
def camera_files(spark, sf_dir):
    """Customers as JPEG files in folders by nation, some of them large; their metadata from the first bytes of each file."""
    c = table(spark, sf_dir, "customer")
    jpeg = _jpeg(F.col("c_mktsegment"), (F.col("c_nationkey") * 100 + 100) % 6400, F.lit("2024:05:06 07:08:09"), F.col("c_custkey") % 700 + 1, F.col("c_custkey") % 2 == 0)
    bytes_ = F.when(F.col("c_custkey") % 9 != 0, jpeg).otherwise(F.unhex(F.lit("FFD8FFD9")))
    rest = F.when(F.col("c_custkey") % 100 == 0, F.unhex(F.repeat(F.lit("00"), 200_000))).otherwise(F.unhex(F.lit("")))
    name = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    path = _folder(spark, "camera")
    heads.write_files(c.select(name.alias("file"), F.concat(bytes_, rest).alias("content")), path)
    found = exif.extract_exif(heads.listed_heads(spark, path), "head")
    number = F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long")
    return found.select(number.alias("id"), "camera_make", "iso", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken"), "latitude", F.col("length").alias("bytes"))
