"""Library queries, jobs, checks, sources and streams on literal rows."""

import gzip
import json
import os
import struct
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoebox import schema
from shoebox.operators import checks, enrich, highlights, jobs, library, people, search, similarity
from shoebox.sources import exif, readers
from shoebox.streaming import streams

M = "id string, org string, name string, description string, location string, taken_at timestamp, trashed_at timestamp, is_favorite boolean"


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def media(spark):
    t = at("2024-01-15T10:00:00")
    rows = [("p1", "o1", "Beach Sunset", None, None, t, None, True), ("p2", "o1", "Family Dinner", "Birthday party", None, t, None, False), ("p3", "o1", "Mountain Trip", "", "Chamonix, France", at("2023-12-31T09:00:00"), None, None), ("p4", "o2", "Office", "", "", None, t, True)]
    return spark.createDataFrame(rows, M)


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(("q", "want"), [("beach", ["p1"]), (" BEACH ", ["p1"]), ("birthday", ["p2"]), ("chamonix", ["p3"]), ("", []), ("   ", []), ("nothing", []), ("o", ["p3", "p4"])])
def test_text_filter(media, q, want):
    assert ids(media.where(library.matches_text(q, "name", "description", "location")).orderBy("id")) == want


def test_hybrid(spark, media):
    near = spark.createDataFrame([("p3", 0.9), ("p2", 0.5), ("p1", 0.7)], "id string, score double")
    hits = media.where("id IN ('p1', 'p4')")
    assert ids(library.hybrid(media, near.where("id <> 'p1'"), hits)) == ["p2", "p3", "p1", "p4"]
    assert ids(library.hybrid(media, near, hits)) == ["p1", "p2", "p3", "p4"]
    assert ids(library.hybrid(media, near, hits, by_score=True)) == ["p3", "p1", "p2", "p4"]
    assert ids(library.hybrid(media, near.limit(0), hits)) == ["p1", "p4"]
    assert ids(library.hybrid(media, near.limit(0), hits.limit(0))) == []


def test_timeline(media):
    out = library.timeline(media, "2024-01-16").collect()
    assert [(r.date, r.label, r.n, r.newest) for r in out] == [("unknown", "Unknown date", 1, "p4"), ("2024-01-15", "Yesterday", 2, "p2"), ("2023-12-31", "December 31, 2023", 1, "p3")]
    assert ids(library.timeline_rows(media, "2024-01-16")) == ["p4", "p1", "p2", "p3"]


def test_sections_and_views(spark, media):
    assert [sorted(ids(media.where(library.in_section(s)))) for s in ("all", "favorites", "trash")] == [["p1", "p2", "p3"], ["p1"], ["p4"]]
    rows = spark.createDataFrame([("c", 1, None), ("a", 2, None), ("a", 3, at("2024-01-01")), ("b", 4, at("2024-01-01")), ("b", 5, None), (None, 6, None)], "id string, pos int, trashed_at timestamp")
    assert ids(library.photo_views(rows, "pos").orderBy("pos")) == ["c", "a"]
    full = spark.createDataFrame([], schema.schema_of("media"))
    assert library.photo_view(full).columns[5] == "takenAt"


def test_people_views(spark):
    who = spark.createDataFrame([("p1", None, "f1"), ("p2", True, "f1"), ("p3", False, "f9")], "id string, is_hidden boolean, thumbnail_face string")
    faces = spark.createDataFrame([("f1", "m1", "p1"), ("f2", "m2", "p1"), ("f3", "m1", "p1")], "id string, photo string, person string")
    media = spark.createDataFrame([("m1", "o", "a.jpg", "", None), ("m2", "o", "b.jpg", "t", at("2024-01-01"))], "id string, org string, file string, thumbnail string, trashed_at timestamp")
    out = {r.id: tuple(r)[3:] for r in people.people_with_thumbnails(who, faces, media).collect()}
    assert out == {"p1": ("m1", "a.jpg", None), "p3": (None, None, None)}
    assert ids(people.person_media(faces, media, "p1")) == ["m1"]
    assert {r.id: r.photo_count for r in people.media_per_person(faces, who).collect()} == {"p1": 2, "p2": 0, "p3": 0}
    assert {(r.id, r.thumbnail) for r in library.file_reference(media).collect()} == {("m1", None), ("m2", "t")}


def test_albums_tags_memories(spark, media):
    items = spark.createDataFrame([("i1", "a", "p3", 1), ("i2", "a", "p1", 2), ("i3", "a", "p3", 3), ("i4", "a", "p4", 0), ("i5", "a", "gone", 9)], "id string, album string, photo string, sort_order long")
    albums = spark.createDataFrame([("a", "p1"), ("b", None)], "id string, cover_photo string")
    assert ids(library.album_photos(items, media)) == ["p3", "p1"]
    assert {r.id: r.item_count for r in library.album_counts(albums, items).collect()} == {"a": 5, "b": 0}
    assert {r.id: r.item_count for r in library.album_counts(albums, items, media).collect()} == {"a": 3, "b": 0}
    assert {r.id: r.cover_photo_row and r.cover_photo_row.name for r in library.with_related(albums, "cover_photo", media).collect()} == {"a": "Beach Sunset", "b": None}
    tags = spark.createDataFrame([("t1", "Sea", None), ("t2", "sea shore", "t1"), ("t3", "City", "t2")], "id string, name string, parent string")
    links = spark.createDataFrame([("p1", "t1"), ("p1", "t2"), ("p2", "t1")], "item string, tag string")
    assert sorted(ids(library.with_tags(media, links, ["t1", "t2"]))) == ["p1", "p2"]
    assert ids(library.with_tags(media, links, ["t1", "t2"], all_of=True)) == ["p1"]
    assert ids(library.tag_suggestions(tags, " SEA")) == ["t1", "t2"]
    assert [library.can_create_tag(tags, q).first()[0] for q in ("SEA", "se", "")] == [False, True, False]
    assert {r.id: r.path for r in library.tag_paths(tags).collect()} == {"t1": "Sea", "t2": "Sea/sea shore", "t3": "Sea/sea shore/City"}
    deep = spark.createDataFrame([(k, f"n{k}", k - 1 if k else None) for k in range(30)] + [(100, "x", 101), (101, "y", 100), (102, "z", 101), (103, "q", 999)], "id long, name string, parent long")
    assert {r.id: (r.path, r.depth) for r in library.tag_paths(deep).collect()} == {k: ("/".join(f"n{j}" for j in range(k + 1)), k) for k in range(30)}
    memories = spark.createDataFrame([("m1", at("2024-01-01")), ("m2", at("2024-02-01"))], "id string, created timestamp")
    own = spark.createDataFrame([("m1", "p2", at("2024-01-03")), ("m1", "p1", at("2024-01-02")), ("m1", "gone", at("2024-01-01"))], "memory string, photo string, created timestamp")
    assert [(r.id, r.photos) for r in library.memory_feed(memories, own, media).collect()] == [("m2", []), ("m1", ["p1", "p2"])]


def test_updates_and_settings(spark, media):
    out = {r.id: r.is_favorite for r in library.update(media, ["p2"], is_favorite=~F.coalesce("is_favorite", F.lit(False))).collect()}
    assert out["p2"] is True and out["p1"] is True
    old = spark.createDataFrame([("a", "x", 5, 1.0), ("b", "y", 6, 2.0)], "id string, make string, iso long, latitude double")
    new = spark.createDataFrame([("a", "", 9, 0.0)], "id string, make string, iso long, latitude double")
    assert {tuple(r) for r in library.patch(old, new, "id").collect()} == {("a", "x", 9, 1.0), ("b", "y", 6, 2.0)}
    assert {tuple(r) for r in library.patch(old, new, "id", always=("make",)).collect()} == {("a", "", 9, 1.0), ("b", "y", 6, 2.0)}
    some = spark.createDataFrame([(False, None)], "ocr_enabled boolean, min_faces int")
    assert library.with_defaults(some).first().asDict() == library.SETTINGS | {"ocr_enabled": False}
    assert library.with_defaults(some.limit(0)).first().asDict() == library.SETTINGS


def test_access(spark, media):
    member = spark.createDataFrame([("u", "o1")], "user string, org string")
    seen = library.visible_to(media, member, "u")
    assert sorted(ids(seen)) == ["p1", "p2", "p3"]
    faces = spark.createDataFrame([("f1", "p1"), ("f2", "p4")], "id string, photo string")
    assert ids(library.visible_children(faces, "photo", seen)) == ["f1"]


def test_live_pairs(spark):
    rows = [("a", "o", "IMG_1.HEIC", "image/heic", 1), ("b", "o", "IMG_1.mov", "video/quicktime", 1), ("c", "o", "IMG_1.mov", "video/quicktime", 2), ("d", "x", "IMG_1.mov", "video/quicktime", 9), ("e", "o", "IMG_10.mov", "video/quicktime", 9), ("f", "o", "IMG_1.heif", "image/heif", 9)]
    df = spark.createDataFrame([(*r[:4], datetime(2024, 1, r[4])) for r in rows], "id string, org string, name string, mime_type string, created timestamp")
    assert {tuple(r) for r in enrich.live_pairs(df).collect()} == {("a", "c"), ("f", "c"), ("b", "a"), ("c", "a")}
    assert ("a", "e") in {tuple(r) for r in enrich.live_pairs(df, prefix=True).collect()}


def test_jobs(spark):
    df = spark.createDataFrame([(1, "pending", 0, None), (2, "processing", 0, None), (3, "processing", 1, None), (4, "processing", 2, None), (5, "failed", 2, None), (6, "failed", 3, None), (7, "pending", 0, at("2024-01-02"))], "id long, status string, attempts long, scheduled_at timestamp").selectExpr("*", "'' last_error", "timestamp '2024-01-01' created_at", "'p' photo", "'x' job_type")
    now = "2024-01-01 00:00:00"
    outcomes = spark.createDataFrame([(2, "bad"), (3, "bad"), (4, "bad"), (1, None)], "id long, error string")
    out = {r.id: (r.status, r.attempts, r.scheduled_at) for r in jobs.apply_outcomes(df, outcomes, now).collect()}
    assert out[1] == ("done", 0, None)
    assert out[2] == ("pending", 1, at("2024-01-01T00:01:00"))
    assert out[3] == ("pending", 2, at("2024-01-01T00:02:00"))
    assert out[4] == ("failed", 3, None)
    again = {r.id: r.status for r in jobs.reconcile(df, now).collect()}
    assert [again[k] for k in range(1, 8)] == ["pending"] * 5 + ["failed", "pending"]
    assert [r.id for r in jobs.due_batch(df, now, 5).collect()] == [1]
    assert {r.status: r.n for r in jobs.status_counts(df).collect()} == {"pending": 2, "processing": 3, "done": 0, "failed": 2}
    m = spark.createDataFrame([("a", 0.0, 0.0, "done"), ("b", 0.0, 2.0, "failed"), ("c", None, None, "")], "id string, latitude double, longitude double, ml_status string")
    n = {r.photo: r["count"] for r in jobs.initial_jobs(m).groupBy("photo").count().collect()}
    assert n == {"a": 4, "b": 5, "c": 4}
    assert jobs.reprocess(m, ["run_ocr", "nope"], "failed").collect() == [("b", "run_ocr")]
    assert jobs.reprocess(m, ["nope"]).count() == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, "", 5, "x"), (2, "ok", -1, None), (3, None, None, "y")], "id long, name string, size long, ref string")
    rules = {"name": checks.required("name"), "size": checks.out_of_range("size", low=0), "long": checks.too_long("name", 1), "enum": checks.not_one_of("ref", "x")}
    assert {tuple(r) for r in checks.violations(df, "id", rules).collect()} == {(1, "name"), (2, "size"), (2, "long"), (3, "name"), (3, "enum")}
    parents = spark.createDataFrame([("x",)], "id string")
    assert ids(checks.dangling(df, "ref", parents)) == [3]
    assert sorted(ids(checks.cascade(df, "ref", parents))) == [2, 3]
    assert {r.id: r.ref for r in checks.clear_reference(df, "ref", parents).collect()} == {1: None, 2: None, 3: "y"}
    assert checks.repeated_keys(df.union(df.limit(1)), "id", "name").count() == 1


def test_highlights(spark):
    rows = [("a", "o", at("2022-05-01T10:00"), False), ("b", "o", at("2023-05-01T10:00"), True), ("c", "o", at("2023-05-01T11:00"), False), ("d", "o", at("2024-05-01T10:00"), False), ("e", "o", None, True)]
    df = spark.createDataFrame(rows, "id string, org string, taken_at timestamp, is_favorite boolean")
    assert {(r.year, r.n, r.newest) for r in highlights.on_this_day(df, "2024-05-01").collect()} == {(2022, 1, "a"), (2023, 2, "c")}
    assert [(r.month, r["rank"], r.id) for r in highlights.best_of_month(df, 1).orderBy("month").collect()] == [("2022-05", 1, "a"), ("2023-05", 1, "b"), ("2024-05", 1, "d")]
    assert [tuple(r) for r in highlights.trips(df, "2 hours", 2).collect()] == [("o", at("2023-05-01T10:00"), at("2023-05-01T11:00"), 2)]


def test_readers(spark, tmp_path):
    line = lambda n, name, lat, lon: "\t".join([str(n), name, "x", "x", str(lat), str(lon), "P", "PPL", "FR", "", "11", *["0"] * 6])
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("\n".join([line(1, "Paris", 48.8, 2.3), "short\tline", line(2, "", 1, 1), line(3, "Null", 0, 0), line(4, "Odd", "1e9", 5)]))
    out = readers.read_gazetteer(spark, str(tmp_path / "c.txt.gz")).collect()
    assert [(r.city, r.lat, r.country, r.state) for r in out] == [("Paris", 48.8, "FR", "11"), ("Odd", 0.0, "FR", "11")]
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": [["<pad>", 0], ["a", -1.5], ["bad", "x"]]}, "added_tokens": [{"id": 7, "content": "<eos>"}]}, indent=1))
    vocabulary, end = readers.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert {tuple(r) for r in vocabulary.collect()} == {(0, "<pad>", 0.0), (1, "a", -1.5)} and end == 7
    probe = spark.createDataFrame([(1, '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":5,"height":6}],"format":{"duration":"1.2349"}}'), (2, "junk"), (3, "{}")], "id long, probe string")
    assert {tuple(r) for r in readers.parse_probe(probe).drop("probe").collect()} == {(1, 1234, 5, 6, "h264"), (2, None, None, None, None), (3, None, None, None, None)}
    v = spark.createDataFrame([(1, "[1,2]"), (2, "[]"), (3, "nope"), (4, "[1]"), (5, None)], "id long, v string")
    assert ids(readers.parse_vectors(v, "v", 2)) == [1]
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, None, True)], "id long, version long, x string, deleted boolean")
    assert [(r.id, r.x) for r in readers.compact(log).collect()] == [(1, "b")]
    rows = spark.createDataFrame([("a", "", 0.0, 0.0), ("b", "x", 0.0, 5.0)], "id string, org string, latitude double, longitude double")
    assert {tuple(r) for r in schema.unset_to_null(rows).collect()} == {("a", None, None, None), ("b", "x", 0.0, 5.0)}
    assert ids(readers.scan(v, "id > 1", [F.desc("id")], limit=2, offset=1)) == [4, 3]
    assert sorted(ids(readers.by_ids(v, spark.createDataFrame([(1,), (1,), (9,)], "id long")))) == [1]
    assert {tuple(r) for r in readers.first_or(log, spark.createDataFrame([(1,), (5,)], "id long"), "id", "x", "none").collect()} == {(1, "a"), (5, "none")}
    tags = spark.createDataFrame([("t1", "a", "", None, "o1", "u", None, None)], schema.schema_of("tags"))
    readers.write_table(tags, str(tmp_path / "tags"))
    readers.write_table(tags, str(tmp_path / "tags"))
    back = readers.read_table(spark, str(tmp_path / "tags"), "tags")
    assert [(r.id, r.color, r.org) for r in back.collect()] == [("t1", None, "o1")] * 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_bytes(b"hi")
    files = spark.createDataFrame([("a.bin",), ("b.bin",)], "file string")
    assert {(r.file, bytes(r.content) if r.content else None) for r in readers.with_content(files, spark, str(tmp_path / "files")).collect()} == {("a.bin", b"hi"), ("b.bin", None)}


def jpeg(order):
    e = {"<": b"II", ">": b"MM"}[order]
    pack = lambda f, *v: struct.pack(order + f, *v)
    data, base = b"", 8 + 2 + 12 * 4 + 4
    sub_at = base + 16
    entry = lambda tag, kind, n, v: pack("HHI", tag, kind, n) + v
    top = pack("H", 4) + entry(0x010F, 2, 6, pack("I", base)) + entry(0x0110, 2, 3, b"X1\0\0") + entry(0x8769, 4, 1, pack("I", sub_at)) + entry(0x8825, 4, 1, pack("I", sub_at + 200)) + pack("I", 0)
    data = b"Canon\0".ljust(16, b"\0")
    values = sub_at + 2 + 12 * 5 + 4
    sub = pack("H", 5) + entry(0x9003, 2, 20, pack("I", values)) + entry(0x8827, 3, 1, pack("H", 400) + b"\0\0") + entry(0x829D, 5, 1, pack("I", values + 20)) + entry(0x920A, 5, 1, pack("I", values + 28)) + entry(0x9286, 7, 7, pack("I", values + 36)) + pack("I", 0)
    sub += b"2024:01:15 10:00:00\0" + pack("II", 28, 10) + pack("II", 0, 0) + b"Lens 50\0"
    gps_at = sub_at + 200
    gps_values = gps_at + 2 + 12 * 4 + 4
    gps = pack("H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, pack("I", gps_values)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, pack("I", gps_values + 24)) + pack("I", 0)
    gps += pack("6I", 10, 1, 30, 1, 0, 1) + pack("6I", 20, 1, 15, 1, 0, 1)
    tiff = e + pack("HI", 42, 8) + top + data + sub.ljust(200, b"\0") + gps
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    files = spark.createDataFrame([("a", bytearray(jpeg(order))), ("b", bytearray(b"\xff\xd8none")), ("c", None), ("d", bytearray(jpeg(order)[:60]))], "id string, content binary")
    out = {r.id: r for r in exif.extract_exif(files).collect()}
    a = out["a"]
    assert (a.camera_make, a.camera_model, a.lens_model, a.iso, a.aperture, a.focal_length, a.taken_at) == ("Canon", "X1", "Lens 50", 400, "f/2.8", None, at("2024-01-15T10:00:00"))
    assert (a.latitude, a.longitude) == (-10.5, 20.25)
    assert out["b"].camera_make is None and out["c"].iso is None and out["d"].taken_at is None


def test_exif_survives_any_bytes():
    r = np.random.default_rng(0)
    whole = jpeg("<")
    for k in range(300):
        data = bytearray(whole)
        for _ in range(6):
            data[r.integers(len(data))] = r.integers(256)
        exif.read_exif(bytes(data[: r.integers(2, len(data))]))


def test_image_hashes(spark, tmp_path):
    import zlib

    def png(path, grey):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        h, w = grey.shape
        raw = b"".join(b"\0" + row.tobytes() for row in grey)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    y, x = np.mgrid[0:90, 0:120]
    png(tmp_path / "a.png", (x * 2).astype(np.uint8))
    png(tmp_path / "b.png", (x * 2 + (y % 2)).astype(np.uint8))
    png(tmp_path / "c.png", ((np.sin(x / 9) * np.cos(y / 5) + 1) * 120).astype(np.uint8))
    (tmp_path / "d.png").write_bytes(b"no image")
    out = {os.path.basename(r.path): r for r in similarity.hash_images(readers.read_images(spark, str(tmp_path))).collect()}
    number = lambda k: int(out[k].perceptual_hash[2:], 16)
    assert out["a.png"].perceptual_hash.startswith("p:") and len(out["a.png"].perceptual_hash) == 18
    assert (number("a.png") ^ number("b.png")).bit_count() <= (number("a.png") ^ number("c.png")).bit_count()
    assert number("a.png") != number("c.png")
    assert out["d.png"].perceptual_hash is None and out["d.png"].error


def test_encoders_and_detectors(spark):
    docs = spark.createDataFrame([(1, "red car"), (2, "blue sea"), (3, "red red car"), (4, None)], "vec_id long, text string")
    corpus = enrich.encode(docs, enrich.hashing_encoder(32), "text")
    asked = spark.createDataFrame([(10, "Red Car"), (11, "  "), (12, None)], "query long, text string")
    out = search.semantic_search(asked, corpus, enrich.hashing_encoder(32), 2).orderBy("query", "rank").collect()
    assert [(r.query, r.id) for r in out] == [(10, 1), (10, 3)]
    found = enrich.detect(spark.createDataFrame([("a", "x")], "photo string, data string"), lambda: lambda values: [[(0, 0, 1, 1, 0.9), (0, 0, 2, 2, 0.1)] for _ in values], "data", min_score=0.5)
    assert [(r.photo, r.bbox.x2, r.score) for r in found.collect()] == [("a", 1.0, 0.9)]


def test_ocr_text_stays_with_its_photo(spark):
    media = spark.createDataFrame([("a", "old"), ("b", ""), ("c", None)], "id string, search_text string")
    regions = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, "one"), ("b", 1, "bee"), ("b", 2, "")], "photo string, pos int, text string")
    assert {r.id: r.search_text for r in enrich.ocr_text(media, regions).collect()} == {"a": "old one two", "b": "bee", "c": None}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("a", 3, "z")], "id string, v long, file string")
    rows.coalesce(1).write.parquet(src)
    stream = readers.change_feed(spark, src, schema=rows.schema)
    streams.run_once(streams.changed_values(stream, "id", "v", "file"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a", 4, "z"), ("b", 2, "w")], rows.schema).coalesce(1).write.mode("append").parquet(src)
    streams.run_once(streams.changed_values(stream, "id", "v", "file"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {("a", 1), ("b", 1), ("a", 3), ("b", 2)}
    due = spark.createDataFrame([(1, "p", "run_ocr", "pending", None, at("2024-01-01"))], "id long, photo string, job_type string, status string, scheduled_at timestamp, created_at timestamp")
    due.write.parquet(str(tmp_path / "jobs"))
    streams.due_batches(readers.change_feed(spark, str(tmp_path / "jobs"), schema=due.schema), "2024-02-01", 5, str(tmp_path / "due"), str(tmp_path / "dc")).awaitTermination()
    assert [(r.job_type, r.n) for r in spark.read.parquet(str(tmp_path / "due")).collect()] == [("run_ocr", 1)]


def test_the_library_imports_without_the_llm_operators():
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('shoebox.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); assert not any(m.startswith('shoebox.llm') for m in sys.modules)"
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_neighbours_across_tasks(spark):
    rows = [(k, "hot" if k % 5 else ["a", None][k % 2], at(f"2024-01-{k % 28 + 1:02d}") if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, org string, taken_at timestamp").repartition(7)
    w = Window.partitionBy("org").orderBy(F.desc("taken_at"), "id")
    want = df.select("org", "id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))
    assert sorted(library.neighbours(df, "org").collect(), key=repr) == sorted(want.collect(), key=repr)
    assert library.neighbours(df.limit(0), "org").count() == 0


def test_pixels_are_rounded_in_double_precision_and_ties_of_frequencies_are_exact(spark, tmp_path):
    """100 x + 128 is 140.499997 for one entry (140.5 in single precision); even images have 63 frequencies of exactly 0."""
    import duckdb

    from shoebox.plans import files

    r = np.random.default_rng(4)
    v = [np.where(np.arange(64) == k, 0.12499997019767761, 0.3 * r.normal(size=64)) for k in range(64)] + [np.full(64, 0.3), np.tile([0.1, -0.2], 32)]
    rows = [(4 * k, x.astype(np.float32).tolist()) for k, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(files.PLANS.oracles["pixel_hashes"]).fetchall())
    assert sorted(tuple(x) for x in files.pixel_hashes(spark, str(tmp_path)).collect()) == want
    assert similarity.dct_hash(np.full((8, 8), 158)) == 1 << 63


def test_files_of_any_length_come_in_parts(spark, tmp_path):
    long = bytes(range(256)) * 5000
    for name, data in (("a.bin", long), ("b.bin", b""), ("c.bin", long[:8192]), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(f"{x}.bin", x) for x in "abcz"], "file string, tag string")
    got = sorted(readers.with_parts(rows, spark, str(tmp_path), part=4096).collect(), key=lambda r: (r.file, r.at or 0))
    assert max(len(r.content or b"") for r in got) == 4096
    whole = {x: b"".join(r.content for r in got if r.file == f"{x}.bin" and r.content is not None) for x in "abc"}
    assert whole == {"a": long, "b": b"", "c": long[:8192]}
    assert [(r.tag, r.at, r.content) for r in got if r.file == "z.bin"] == [("z", None, None)]
    assert [r.at for r in got if r.file == "c.bin"] == [0, 4096]
