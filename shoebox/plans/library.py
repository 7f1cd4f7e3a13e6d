"""Library queries over orders (albums, memories, photos), line items (links), parts (photos) and events (a timeline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo, highlights, library
from .base import Plans, table

PLANS = Plans()
TODAY = "2024-01-30"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("taken_at"), F.col("user_id").alias("org"), "event_type", "value")


_LABEL = "CASE strftime(ts, '%Y-%m-%d') WHEN '2024-01-30' THEN 'Today' WHEN '2024-01-29' THEN 'Yesterday' ELSE strftime(ts, '%B ') || day(ts) || strftime(ts, ', %Y') END"


@PLANS.add(f"""
    SELECT strftime(ts, '%Y-%m-%d') AS date, max({_LABEL}) AS label, count(*) AS n,
           (max((ts, event_id))).event_id AS newest FROM (SELECT {{'ts': ts, 'event_id': event_id}} AS k, ts, event_id FROM events) GROUP BY 1""".replace("(max((ts, event_id))).event_id", "max(k).event_id"))
def timeline(spark, sf_dir):
    return library.timeline(_events(spark, sf_dir), TODAY)


@PLANS.add(f"SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date, {_LABEL} AS label FROM events")
def timeline_rows(spark, sf_dir):
    return library.timeline_rows(_events(spark, sf_dir), TODAY).select("id", "date", "label")


@PLANS.add("""
    SELECT user_id AS org, event_id AS id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id)""")
def timeline_neighbors(spark, sf_dir):
    return library.neighbours(_events(spark, sf_dir), "org")


@PLANS.add("""
    SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    WHERE b IS NULL OR b <> event_type""")
def changed_files(spark, sf_dir):
    return library.changed(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "event_type")


@PLANS.add("""
    SELECT user_id AS org, year(ts) AS year, count(*) AS n, max(k).event_id AS newest FROM (SELECT {'ts': ts, 'event_id': event_id} AS k, ts, user_id FROM events)
    WHERE month(ts) = 1 AND day(ts) = 15 GROUP BY ALL""")
def on_this_day(spark, sf_dir):
    out = highlights.on_this_day(_events(spark, sf_dir), "2026-01-15")
    return out.select("org", F.col("year").cast("long").alias("year"), "n", "newest")


@PLANS.add("""
    SELECT o_custkey AS org, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')
        ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey) AS rank, o_orderkey AS id FROM orders QUALIFY rank <= 2""")
def best_of_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org"), F.col("o_orderdate").alias("taken_at"), (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"))
    return highlights.best_of_month(o, 2)


@PLANS.add("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id AS org, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM n GROUP BY user_id, k HAVING count(*) >= 3""")
def trips(spark, sf_dir):
    return highlights.trips(_events(spark, sf_dir), "12 hours", 3)


def _album_tables(spark, sf_dir):
    albums = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("org"), F.col("o_orderdate").alias("created"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album"), F.col("l_partkey").alias("photo"), F.col("l_linenumber").cast("long").alias("sort_order"), F.col("l_shipdate").alias("created"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    media = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 10 == 0, F.timestamp_seconds(F.lit(0))).alias("trashed_at"))
    return albums, items, media


@PLANS.add("""
    SELECT l_orderkey AS album, min(l_linenumber)::BIGINT AS sort_order, l_partkey AS id, p_name AS name
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 10 <> 0 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, p_name"))
def album_view(spark, sf_dir):
    _, items, media = _album_tables(spark, sf_dir)
    return library.album_photos(items, media).select("album", "sort_order", "id", "name")


@PLANS.add("""
    SELECT o_orderkey AS id, count(l_orderkey) AS item_count, count(l_orderkey) FILTER (p_size % 10 <> 0) AS kept_count
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def album_counts(spark, sf_dir):
    albums, items, media = _album_tables(spark, sf_dir)
    kept = library.album_counts(albums, items, media).select("id", F.col("item_count").alias("kept_count"))
    return library.album_counts(albums, items).join(kept, "id").select("id", "item_count", "kept_count")


@PLANS.add("SELECT o_orderkey AS id, p_name AS cover_name FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 700")
def album_covers(spark, sf_dir):
    albums, _, media = _album_tables(spark, sf_dir)
    out = library.with_related(albums.withColumn("cover_photo", F.col("id") % 700), "cover_photo", media, name="cover")
    return out.select("id", F.col("cover.name").alias("cover_name"))


@PLANS.add("SELECT l_orderkey * 10 + l_linenumber AS id, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 100 - l_linenumber END, l_linenumber)::BIGINT AS sort_order FROM lineitem")
def album_reorder(spark, sf_dir):
    _, items, _ = _album_tables(spark, sf_dir)
    order = items.where("sort_order % 2 = 0").select("id", (100 - F.col("sort_order")).alias("sort_order"))
    return library.reorder(items, order).select("id", "sort_order")


@PLANS.add("""
    SELECT o_orderkey AS id, coalesce(p, '') AS photos FROM orders LEFT JOIN (
        SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_shipdate, l_partkey) AS p FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0)
        GROUP BY ALL) ON l_orderkey = o_orderkey""")
def memory_feed(spark, sf_dir):
    albums, items, media = _album_tables(spark, sf_dir)
    out = library.memory_feed(albums, items.withColumnRenamed("album", "memory"), media.where("trashed_at IS NULL"))
    return out.select("id", F.array_join("photos", " ").alias("photos"))


def _tags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("tag"))


@PLANS.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag || '-' || l_linestatus IN ('R-F', 'A-F'))")
def tag_filter_any(spark, sf_dir):
    return library.with_tags(_album_tables(spark, sf_dir)[0], _tags(spark, sf_dir), ["R-F", "A-F"]).select("id")


@PLANS.add("""
    SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag || '-' || l_linestatus IN ('R-F', 'A-F')
    AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(DISTINCT l_returnflag || '-' || l_linestatus) = 2""")
def tag_filter_all(spark, sf_dir):
    return library.with_tags(_album_tables(spark, sf_dir)[0], _tags(spark, sf_dir), ["R-F", "A-F"], all_of=True).select("id")


@PLANS.add("SELECT DISTINCT l_orderkey AS item, l_returnflag AS id, ascii(l_returnflag)::BIGINT AS color FROM lineitem")
def item_tags(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("tag"))
    tags = links.select(F.col("tag").alias("id"), F.ascii("tag").cast("long").alias("color")).distinct()
    return library.tags_of(links, tags)


@PLANS.add("""
    SELECT 'r' || r_regionkey AS id, r_name AS path, 0 AS depth FROM region
    UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def tag_paths(spark, sf_dir):
    node = lambda t, mark, k, name, up: table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(k)).alias("id"), F.col(name).alias("name"), up.alias("parent"))
    tags = node("region", "r", "r_regionkey", "r_name", F.lit(None).cast("string"))
    tags = tags.union(node("nation", "n", "n_nationkey", "n_name", F.concat(F.lit("r"), "n_regionkey"))).union(node("customer", "c", "c_custkey", "c_name", F.concat(F.lit("n"), "c_nationkey")))
    return library.tag_paths(tags)


@PLANS.add("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%an%'")
def tag_typeahead(spark, sf_dir):
    return library.tag_suggestions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), " AN ")


@PLANS.add("""
    SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def access_scope(spark, sf_dir):
    member = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("user"), F.col("n_nationkey").alias("org"))
    seen = library.visible_to(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org")), member, 1)
    return library.visible_children(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner")), "owner", seen).select("id")


@PLANS.add("""
    SELECT o_orderpriority AS location, count(*) AS n, max(k).lat AS latitude, max(k).lon AS longitude, max(k).key AS cover FROM (
        SELECT o_orderpriority, {'d': o_orderdate, 'key': o_orderkey, 'lat': (o_custkey % 90)::DOUBLE, 'lon': (o_custkey % 180)::DOUBLE} AS k FROM orders) GROUP BY 1""")
def map_clusters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    media = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("location"), F.col("o_orderdate").alias("taken_at"), (F.col("o_custkey") % 90).cast("double").alias("latitude"), (F.col("o_custkey") % 180).cast("double").alias("longitude"))
    return geo.map_clusters(media)


_KM = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"


@PLANS.add(f"""
    WITH p AS (SELECT c_custkey AS id, 40 + (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat, (c_custkey * 91 % 2000) / 100.0::DOUBLE AS lon FROM customer),
    g AS (SELECT s_suppkey AS pos, s_name, 40 + (s_suppkey * 53 % 1000) / 100.0::DOUBLE AS lat, (s_suppkey * 97 % 2000) / 100.0::DOUBLE AS lon FROM supplier),
    d AS (SELECT id, pos, s_name, least(1.0, pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2)) AS h FROM p, g),
    n AS (SELECT id, s_name, {_KM} AS km, row_number() OVER (PARTITION BY id ORDER BY {_KM}, pos) AS k FROM d)
    SELECT p.id, n.s_name AS city, round(n.km, 6) AS distance_km FROM p LEFT JOIN n ON n.id = p.id AND n.k = 1 AND n.km <= 50""")
def reverse_geocode(spark, sf_dir):
    at = lambda k, a, b: ((40 + (F.col(k) * a % 1000) / 100.0), ((F.col(k) * b % 2000) / 100.0))
    lat, lon = at("c_custkey", 37, 91)
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lat.alias("latitude"), lon.alias("longitude"))
    lat, lon = at("s_suppkey", 53, 97)
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), lat.alias("lat"), lon.alias("lon"), F.col("s_name").alias("city"), F.lit("").alias("state"), F.lit("").alias("country"))
    return geo.nearest_place(points, places).select("id", "city", F.round("distance_km", 6).alias("distance_km"))
