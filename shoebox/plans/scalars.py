"""Scalar functions over parts, line items, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import Plans, table

PLANS = Plans()


@PLANS.add("""
    SELECT c_custkey AS id, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT c_custkey,
        least(1.0, pow(sin(radians(c_acctbal / 200 - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(c_acctbal / 200)) * pow(sin(radians(c_nationkey * 7 - 20.0) / 2), 2)) AS h FROM customer)""")
def scalar_haversine(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(S.haversine_km(F.lit(10.0), F.lit(20.0), F.col("c_acctbal") / 200, (F.col("c_nationkey") * 7).cast("double")), 6).alias("km"))


@PLANS.add("""
    WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey % 20)::DOUBLE AS ax, (l_suppkey % 20)::DOUBLE AS ay, 10.0 + l_linenumber AS aw FROM lineitem),
    o AS (SELECT *, least(ax + aw, 25.0) - greatest(ax, 5.0) AS w, least(ay + 10, 25.0) - greatest(ay, 5.0) AS h FROM b)
    SELECT id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0.0 ELSE w * h / (aw * 10 + 400 - w * h) END, 6) AS iou FROM o""")
def scalar_iou(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 20).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    a = F.struct(x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_linenumber")).alias("x2"), (y + 10).alias("y2"))
    b = F.struct(F.lit(5.0).alias("x1"), F.lit(5.0).alias("y1"), F.lit(25.0).alias("x2"), F.lit(25.0).alias("y2"))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), a.alias("a"), b.alias("b"))
    return rows.select("id", F.round(S.iou(F.col("a"), F.col("b")), 6).alias("iou"))


_T = "(20 * n + s) // (2 * s)"


@PLANS.add(f"""
    WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_partkey * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 30000000 END) END AS n FROM lineitem),
    y AS (SELECT *, CASE WHEN n < 1024 THEN 1 WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END::BIGINT AS s,
        CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS u FROM x)
    SELECT id, CASE WHEN n <= 0 THEN '0 B' WHEN {_T} % 10 = 0 THEN ({_T} // 10)::VARCHAR || ' ' || u ELSE ({_T} // 10)::VARCHAR || '.' || ({_T} % 10)::VARCHAR || ' ' || u END AS size_text,
        (n // 60000)::VARCHAR || ':' || lpad((n // 1000 % 60)::VARCHAR, 2, '0') AS duration_text FROM y""")
def scalar_sizes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1000, 1000000, 30000000)]), F.col("l_linenumber") % 4 + 1)
    n = F.when(F.col("l_linenumber") == 7, F.lit(0).cast("long")).otherwise(F.col("l_partkey") * k)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), n.alias("n")).select("id", S.byte_size_text(F.col("n")).alias("size_text"), S.duration_text(F.col("n")).alias("duration_text"))


@PLANS.add("""
    SELECT o_orderkey AS id, replace(lower(o_orderpriority), '_', ' ') AS label, concat_ws(', ', nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '')) AS place,
        CASE WHEN o_custkey % 3 = 1 THEN (o_custkey % 3)::VARCHAR || ' photo' ELSE (o_custkey % 3)::VARCHAR || ' photos' END AS count_text,
        (100 - o_custkey % 7)::VARCHAR || '% similar' AS similar_text, 30 * (1 << (o_custkey % 4)::INT)::BIGINT AS delay, o_orderstatus <> 'F' AS has_camera FROM orders""")
def scalar_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), S.memory_label(F.lower("o_orderpriority")).alias("label"), S.place_text(status, F.col("o_orderpriority"), F.lit("")).alias("place"), S.count_text(F.col("o_custkey") % 3, "photo").alias("count_text"), S.similarity_text(F.col("o_custkey") % 7).alias("similar_text"), S.retry_delay_seconds(F.col("o_custkey") % 4).alias("delay"), S.has_camera_data(status, F.lit(0)).alias("has_camera"))


@PLANS.add("""
    SELECT l_orderkey * 10 + l_linenumber AS id, printf('f/%.1f', l_quantity / 10 + 0.01) AS aperture,
        CASE WHEN l_quantity * 4 + 0.01 >= 100 THEN printf('%.0fmm', l_quantity * 4 + 0.01) ELSE printf('%.1fmm', l_quantity * 4 + 0.01) END AS focal,
        round((CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (l_quantity + l_linenumber / 60.0 + 30 / 3600.0), 6) AS degrees,
        strftime(l_shipdate, '%Y-%m-%d') AS taken, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity / 4 END AS number FROM lineitem""")
def scalar_exif(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("N")
    taken = S.exif_time(F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss"))
    number = F.when(F.col("l_linenumber") == 1, "1e5x").otherwise((F.col("l_quantity") / 4).cast("decimal(12,4)").cast("string"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), S.aperture_text(F.col("l_quantity") / 10 + 0.01).alias("aperture"), S.focal_text(F.col("l_quantity") * 4 + 0.01).alias("focal"), F.round(S.dms_to_degrees(F.col("l_quantity"), F.col("l_linenumber"), F.lit(30), ref), 6).alias("degrees"), S.day_key(taken).alias("taken"), S.lenient_number(number).alias("number"))


@PLANS.add("""
    SELECT p_partkey AS id, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.tar' ELSE '' END AS stem, lower(e) AS extension,
        CASE lower(e) WHEN 'jpeg' THEN 'image/jpeg' WHEN 'mkv' THEN 'video/x-matroska' WHEN 'avif' THEN 'image/avif' ELSE 'application/octet-stream' END AS mime,
        lower(e) IN ('jpeg', 'avif') AS image, lower(e) = 'mkv' AS video FROM (SELECT p_partkey, ['JPEG', 'mkv', 'Avif', 'doc'][(p_partkey % 4 + 1)::INT] AS e FROM part)""")
def scalar_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, ("JPEG", "mkv", "Avif", "doc"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".tar").otherwise(""), F.lit("."), ext)
    rows = p.select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("mime", S.mime_from_name(F.col("name")))
    return rows.select("id", S.file_stem(F.col("name")).alias("stem"), S.file_extension(F.col("name")).alias("extension"), "mime", S.is_supported_image(F.col("mime")).alias("image"), S.is_supported_video(F.col("mime")).alias("video"))
