"""Media rows derived from parts, orders and line items: views, updates, enrichment, detections, table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes, checks, enrich, library
from ..sources import readers
from .base import Plans, table

PLANS = Plans()


def _versions(spark, sf_dir):
    """Line items as rows of photos that may repeat; the first by order decides."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("trashed_at"), (F.col("l_linestatus") == "F").alias("is_favorite"))


@PLANS.add("""
    SELECT id, pos FROM (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, l_returnflag,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k = 1 AND l_returnflag <> 'R'""")
def photo_views(spark, sf_dir):
    return library.photo_views(_versions(spark, sf_dir), "pos").select("id", "pos")


@PLANS.add("""
    SELECT count(*) FILTER (l_returnflag <> 'R') AS kept, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS favorites,
           count(*) FILTER (l_returnflag = 'R') AS trash, l_partkey AS id FROM lineitem GROUP BY l_partkey""")
def sections(spark, sf_dir):
    n = lambda s: F.count_if(library.in_section(s))
    return _versions(spark, sf_dir).groupBy("id").agg(n("all").alias("kept"), n("favorites").alias("favorites"), n("trash").alias("trash"))


@PLANS.add("SELECT doc_id AS id FROM documents WHERE lower(source) LIKE '%src1%' OR lower(text) LIKE '%license%'")
def text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(library.matches_text(" SRC1", "source") | library.matches_text("License", "text")).select(F.col("doc_id").alias("id"))


def _media(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, ("heic", "mov", "jpg", "HEIF", "mp4", "bin"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat(F.lit("IMG_"), F.expr("p_partkey div 2").cast("string"), F.lit("."), ext)
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("org"), name.alias("name"), name.alias("file"), F.lit("").alias("mime_type"), F.lit("").alias("ml_status"), F.lit("").alias("type"), F.lit(None).cast("timestamp").alias("taken_at"), F.timestamp_seconds(F.col("p_partkey")).alias("created"), (F.col("p_partkey") * 37 % 5000 + 1).alias("width"), (F.col("p_partkey") * 53 % 5000 + 1).alias("height"), F.col("p_brand").alias("description"))


_EXT = "['heic', 'mov', 'jpg', 'HEIF', 'mp4', 'bin'][(p_partkey % 6 + 1)::INT]"
_MIME = "['image/heic', 'video/quicktime', 'image/jpeg', 'image/heif', 'video/mp4', 'application/octet-stream'][(p_partkey % 6 + 1)::INT]"


@PLANS.add(f"""
    SELECT p_partkey AS id, {_MIME} AS mime_type, CASE WHEN {_MIME} LIKE 'video/%' THEN 'video' ELSE 'image' END AS type, 'pending' AS ml_status, TIMESTAMP '2024-06-01 00:00:00' AS taken_at FROM part""")
def ingest_defaults(spark, sf_dir):
    return enrich.ingest_defaults(_media(spark, sf_dir), "2024-06-01 00:00:00").select("id", "mime_type", "type", "ml_status", "taken_at")


@PLANS.add(f"""
    WITH m AS (SELECT p_partkey AS id, p_size % 3 AS org, p_partkey // 2 AS stem, {_MIME} AS mime FROM part),
    x AS (SELECT a.id AS photo, b.id AS video, a.mime = 'image/heic' AS heic FROM m a JOIN m b ON a.org = b.org AND a.stem = b.stem AND a.mime IN ('image/heic', 'image/heif') AND b.mime = 'video/quicktime')
    SELECT photo AS id, max(video) AS partner FROM x GROUP BY 1 UNION ALL SELECT video, arg_max(photo, heic::INT * 1000000000 + photo) FROM x GROUP BY 1""")
def live_photo_pairs(spark, sf_dir):
    return enrich.live_pairs(enrich.ingest_defaults(_media(spark, sf_dir), "2024-06-01 00:00:00"))


@PLANS.add(f"""
    WITH m AS (SELECT p_partkey AS id, p_partkey * 37 % 5000 + 1 AS w, p_partkey * 53 % 5000 + 1 AS h, CASE WHEN p_size % 3 = 1 THEN 2048 ELSE 1024 END AS most, CASE WHEN p_size % 3 = 1 THEN 92 ELSE 75 END AS quality FROM part)
    SELECT id, CASE WHEN greatest(w, h) <= most THEN w WHEN w >= h THEN most ELSE w * most // h END AS width,
           CASE WHEN greatest(w, h) <= most THEN h WHEN w >= h THEN h * most // w ELSE most END AS height, quality, greatest(w, h) > most AS needed FROM m""")
def thumbnail_plan(spark, sf_dir):
    media = enrich.ingest_defaults(_media(spark, sf_dir), "2024-06-01 00:00:00")
    settings = media.select("org").distinct().where("org < 2").withColumn("thumbnail_quality", F.when(F.col("org") == 1, "high").otherwise("optimized"))
    return enrich.thumbnail_plan(media, settings)


@PLANS.add("SELECT p_partkey AS id, p_partkey % 5 = 0 AS is_favorite, CASE WHEN p_partkey % 7 = 0 AND p_size > 10 THEN p_name ELSE p_brand END AS description FROM part")
def media_updates(spark, sf_dir):
    media = _media(spark, sf_dir).withColumn("is_favorite", F.col("id") % 5 == 0)
    p = table(spark, sf_dir, "part")
    new = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("description"))
    return library.patch(media, new, "id").select("id", "is_favorite", "description")


@PLANS.add("""
    SELECT user_id AS id, event_id AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'""")
def compacted_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return readers.compact(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value", (F.col("event_type") == "error").alias("deleted")))


@PLANS.add("""
    SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity * 1000 + l_linenumber)::BIGINT AS duration_ms, l_partkey AS width, l_suppkey AS height, 'h264' AS codec FROM lineitem""")
def probe_json(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    streams = F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")), F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height")))
    seconds = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".00"), F.col("l_linenumber").cast("string"), F.lit("999"))
    probe = F.to_json(F.struct(streams.alias("streams"), F.struct(seconds.alias("duration")).alias("format")))
    return readers.parse_probe(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), probe.alias("probe"))).select("id", "duration_ms", "width", "height", "codec")


@PLANS.add("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 3 <> 0")
def vector_json(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.lit("[1, oops")).otherwise(F.to_json("embedding")).alias("v"))
    return readers.parse_vectors(e, "v", 64).select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@PLANS.add("""
    SELECT l_orderkey AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'note' || CASE WHEN count(*) > 0 THEN ' ' ELSE '' END ELSE '' END || string_agg(t, ' ' ORDER BY k, t) AS search_text FROM (
        SELECT l_orderkey, l_shipdate_text AS t, min(l_linenumber) AS k FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipdate_text FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def ocr_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    media = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("search_text", F.when(F.col("id") % 2 == 0, "note").otherwise(""))
    regions = li.select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return enrich.ocr_text(media, regions).select("id", "search_text")


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_linenumber")).alias("x2"), (y + 20).alias("y2"))
    return li.select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("pos"), box.alias("bbox"), (F.col("l_extendedprice") / 1e6).alias("score"))


_BOXES = """
    SELECT l_orderkey AS photo, l_linenumber AS pos, l_extendedprice / 1e6 AS score, {'x1': x, 'y1': y, 'x2': x + 20 + l_linenumber, 'y2': y + 20} AS box
    FROM (SELECT *, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y FROM lineitem)"""
_OVERLAP = "(greatest(0, least(q.x2, b.box.x2) - greatest(q.x1, b.box.x1)) * greatest(0, least(q.y2, b.box.y2) - greatest(q.y1, b.box.y1)))"


@PLANS.add(f"""
    WITH RECURSIVE b AS (SELECT photo, score, box, row_number() OVER (PARTITION BY photo ORDER BY score DESC, box.x1, box.y1, box.x2, box.y2) AS k FROM ({_BOXES})),
    r AS (SELECT photo, k, [box] AS kept, [score] AS scores FROM b WHERE k = 1
        UNION ALL SELECT photo, k, CASE WHEN hit THEN kept ELSE list_append(kept, box) END, CASE WHEN hit THEN scores ELSE list_append(scores, score) END FROM (
            SELECT b.photo, b.k, r.kept, r.scores, b.box, b.score, len(list_filter(r.kept, lambda q: {_OVERLAP} / ((q.x2 - q.x1) * (q.y2 - q.y1) + (b.box.x2 - b.box.x1) * (b.box.y2 - b.box.y1) - {_OVERLAP}) > 0.4)) > 0 AS hit
            FROM r JOIN b ON b.photo = r.photo AND b.k = r.k + 1)),
    t AS (SELECT photo, unnest(kept) AS q, unnest(scores) AS score, unnest(range(len(kept))) AS rank FROM r WHERE (photo, k) IN (SELECT photo, max(k) FROM b GROUP BY photo))
    SELECT photo, rank::INT AS rank, q.x1 AS x1, q.y1 AS y1, q.x2 AS x2, q.y2 AS y2, score FROM t""")
def nms(spark, sf_dir):
    out = boxes.suppress(_boxes(spark, sf_dir), 0.4)
    return out.select("photo", "rank", "box.x1", "box.y1", "box.x2", "box.y2", "score")


@PLANS.add(f"""
    WITH RECURSIVE b AS (SELECT photo, box, row_number() OVER (PARTITION BY photo ORDER BY pos, box.x1, box.y1, box.x2, box.y2) AS k FROM ({_BOXES})),
    r AS (SELECT photo, k, [box] AS boxes FROM b WHERE k = 1
        UNION ALL SELECT photo, k, CASE WHEN box.x1 <= q.x2 + 5 AND box.y1 >= q.y1 - 10 AND box.y1 <= q.y2 + 10
            THEN list_append(boxes[:-2], {{'x1': least(q.x1, box.x1), 'y1': least(q.y1, box.y1), 'x2': greatest(q.x2, box.x2), 'y2': greatest(q.y2, box.y2)}}) ELSE list_append(boxes, box) END FROM (
            SELECT b.photo, b.k, r.boxes, r.boxes[-1] AS q, b.box FROM r JOIN b ON b.photo = r.photo AND b.k = r.k + 1)),
    t AS (SELECT photo, unnest(boxes) AS q, unnest(range(len(boxes))) AS pos FROM r WHERE (photo, k) IN (SELECT photo, max(k) FROM b GROUP BY photo))
    SELECT photo, pos::INT AS pos, q.x1 AS x1, q.y1 AS y1, q.x2 AS x2, q.y2 AS y2 FROM t""")
def box_merge(spark, sf_dir):
    return boxes.merge_text_boxes(_boxes(spark, sf_dir)).select("photo", F.posexplode("boxes").alias("pos", "b")).select("photo", "pos", "b.*")


@PLANS.add("""
    SELECT l_orderkey AS photo, l_linenumber AS pos, greatest(0.0, x1) AS x1, greatest(0.0, y1) AS y1, least(50.0, x1 + 20 + l_linenumber) AS x2, least(40.0, y1 + 20) AS y2
    FROM (SELECT *, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1 FROM lineitem) WHERE x1 < 50 AND y1 < 40""")
def clamped_boxes(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumns({"image_width": F.lit(50), "image_height": F.lit(40)})
    return boxes.clamped(rows).select("photo", "pos", "bbox.*")


@PLANS.add("""
    SELECT l_orderkey * 10 + l_linenumber AS id, rule FROM (SELECT *, unnest([
        CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END, CASE WHEN length(l_linestatus) > 0 AND l_discount > 0.09 THEN 'discount' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL""")
def constraint_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = {"quantity": checks.out_of_range("l_quantity", high=45), "flag": checks.not_one_of("l_returnflag", "A", "N"), "discount": checks.out_of_range("l_discount", high=0.09), "status": checks.required("l_linestatus"), "long": checks.too_long("l_linestatus", 5)}
    return checks.violations(li, "id", rules)


@PLANS.add("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_links(spark, sf_dir):
    return checks.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@PLANS.add("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 <> 0)")
def dangling_links(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("id"))
    return checks.dangling(table(spark, sf_dir, "lineitem"), "l_partkey", parts).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@PLANS.add("""
    SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 5 <> 0)""")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("id"))
    left = checks.cascade(table(spark, sf_dir, "lineitem"), "l_partkey", gone)
    who = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id"))
    return checks.clear_reference(left, "l_suppkey", who).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey")


@PLANS.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def table_page(spark, sf_dir):
    page = readers.scan(table(spark, sf_dir, "orders"), "o_orderstatus = 'F'", [F.desc("o_totalprice"), F.col("o_orderkey")], limit=20, offset=5)
    return page.select("o_orderkey", "o_totalprice")


@PLANS.add("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def rows_by_id(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return readers.by_ids(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), wanted).select("o_orderkey")


@PLANS.add("SELECT c_custkey AS o_custkey, coalesce(min(o_orderpriority), 'none') AS o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def first_or_default(spark, sf_dir):
    return readers.first_or(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_orderpriority", "none")


def _full_media(spark, sf_dir):
    own = _media(spark, sf_dir).withColumns({"is_favorite": F.col("id") % 5 == 0, "thumbnail": F.when(F.col("id") % 2 == 0, "t.jpg").otherwise("")})
    return own.withColumns({c: F.lit(None).cast("string") for c in library.VIEW if c not in own.columns})


@PLANS.add(f"SELECT p_partkey AS id, 'IMG_' || p_partkey // 2 || '.' || {_EXT} AS file, p_partkey % 5 = 0 AS \"isFavorite\", p_partkey * 37 % 5000 + 1 AS width, 30 AS columns FROM part")
def photo_view(spark, sf_dir):
    out = library.photo_view(_full_media(spark, sf_dir))
    return out.select("id", "file", "isFavorite", "width", F.lit(len(out.columns)).alias("columns"))


@PLANS.add(f"SELECT p_partkey AS id, 'IMG_' || p_partkey // 2 || '.' || {_EXT} AS file, CASE WHEN p_partkey % 2 = 0 THEN 't.jpg' END AS thumbnail FROM part")
def file_references(spark, sf_dir):
    return library.file_reference(_full_media(spark, sf_dir))


@PLANS.add("SELECT p_partkey AS id, CASE WHEN p_partkey IN (5, 6, 7) THEN p_partkey % 5 <> 0 ELSE p_partkey % 5 = 0 END AS is_favorite FROM part")
def toggled_favorites(spark, sf_dir):
    return library.update(_full_media(spark, sf_dir), [5, 6, 7], is_favorite=~F.col("is_favorite")).select("id", "is_favorite")


@PLANS.add("SELECT doc_id AS photo, count(*) AS n, max(length(x))::DOUBLE AS widest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE length(x) >= 20 GROUP BY 1")
def detected_boxes(spark, sf_dir):
    """A stand-in detector over documents: a box for each line, as wide as the line."""

    def make():
        return lambda texts: [[(0.0, 20.0 * k, float(len(x)), 20.0 * k + 15, min(1.0, len(x) / 100)) for k, x in enumerate((t or "").split("\n"))] for t in texts]

    found = enrich.detect(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo"), "text"), make, "text", min_score=0.2)
    return boxes.suppress(found).groupBy("photo").agg(F.count("*").alias("n"), F.max("box.x2").alias("widest"))
