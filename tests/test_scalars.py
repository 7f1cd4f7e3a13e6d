from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shoebox.functions import scalars as S


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize(
    ("a", "b", "distance"),
    [((1, 2), (1, 2), 0), ((1, 0), (0, 1), 1), ((1, 0), (-1, 0), 2), ((0, 0), (1, 2), 1), ((0, 0), (0, 0), 1), ((1, 2, 3), (2, 4, 6), 0)],
)
def test_cosine(spark, a, b, distance):
    assert value(spark, S.cosine_distance(vec(*a), vec(*b))) == pytest.approx(distance)
    assert value(spark, S.cosine_distance(vec(*b), vec(*a))) == pytest.approx(distance)
    assert value(spark, S.cosine_similarity(vec(*a), vec(*b))) == pytest.approx(1 - distance)


@pytest.mark.parametrize(
    ("a", "b", "d"),
    [("p:0000000000000000", "p:0000000000000000", 0), ("p:ffffffffffffffff", "p:0000000000000000", 64), ("p:8000000000000001", "p:0000000000000000", 2), ("bad", "p:0000000000000000", None), ("p:12", "p:0000000000000000", None), ("p:FFFFFFFF00000000", "p:ffffffff00000000", 0)],
)
def test_hamming(spark, a, b, d):
    assert value(spark, S.hamming(S.hash_halves(F.lit(a)), S.hash_halves(F.lit(b)))) == d


def test_haversine(spark):
    km = lambda *x: value(spark, S.haversine_km(*[F.lit(float(v)) for v in x]))
    assert km(48.8566, 2.3522, 48.8566, 2.3522) == 0
    assert km(48.8566, 2.3522, 51.5074, -0.1278) == pytest.approx(340, abs=20)
    assert 3800 < km(40.7128, -74.006, 34.0522, -118.2437) < 4100
    assert 100 < km(0, 0, 1, 0) < 120
    assert km(0, 0, 0, 180) == pytest.approx(20015.1, abs=1)


@pytest.mark.parametrize(("a", "b", "x"), [((0, 0, 10, 10), (0, 0, 10, 10), 1), ((0, 0, 1, 1), (5, 5, 6, 6), 0), ((0, 0, 10, 10), (10, 0, 20, 10), 0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3)])
def test_iou(spark, a, b, x):
    box = lambda v: F.struct(*[F.lit(float(n)).alias(k) for k, n in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    assert value(spark, S.iou(box(a), box(b))) == pytest.approx(x)
    assert value(spark, S.iou(box(b), box(a))) == pytest.approx(x)


@pytest.mark.parametrize(("w", "h", "size"), [(4000, 3000, (1024, 768)), (3000, 4000, (768, 1024)), (800, 600, (800, 600)), (1024, 5, (1024, 5)), (3001, 7, (1024, 2)), (2000, 2000, (1024, 1024))])
def test_thumbnail_size(spark, w, h, size):
    a, b = S.thumbnail_size(F.lit(w), F.lit(h), F.lit(1024))
    assert (value(spark, a), value(spark, b)) == size


@pytest.mark.parametrize(("text", "x"), [("0", 0), ("1", 1), ("-1", -1), ("3.14", 3.14), ("-2.5", -2.5), ("100", 100), ("0.5", 0.5), ("12.345", 12.345), ("-0.001", -0.001), ("", 0), (".", 0), ("-", 0), ("x", 0), (None, 0)])
def test_lenient_number(spark, text, x):
    assert value(spark, S.lenient_number(F.lit(text).cast("string"))) == x


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (2 << 20, "2 MB"), (5 * 1024**4, "5120 GB"), (None, "0 B")])
def test_byte_size(spark, n, text):
    assert value(spark, S.byte_size_text(F.lit(n).cast("long"))) == text


def test_texts(spark):
    assert value(spark, S.duration_text(F.lit(65_999))) == "1:05"
    assert value(spark, S.duration_text(F.lit(600_000))) == "10:00"
    assert value(spark, S.aperture_text(F.lit(2.8))) == "f/2.8"
    assert value(spark, S.focal_text(F.lit(100.4))) == "100mm"
    assert value(spark, S.focal_text(F.lit(35.0))) == "35.0mm"
    assert value(spark, S.place_text(F.lit("Paris"), F.lit(""), F.lit("FR"))) == "Paris, FR"
    assert value(spark, S.place_text(F.lit(None).cast("string"), F.lit(""), F.lit(""))) == ""
    assert value(spark, S.exif_time(F.lit("2024:01:15 10:00:00"))) == datetime(2024, 1, 15, 10)
    assert value(spark, S.exif_time(F.lit("junk"))) is None
    assert value(spark, S.file_stem(F.lit("a.b.HEIC"))) == "a.b"
    assert value(spark, S.file_extension(F.lit("a.b.HEIC"))) == "heic"
    assert value(spark, S.mime_from_name(F.lit("noext"))) == "application/octet-stream"
    assert value(spark, S.dms_to_degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("W"))) == -10.5
    assert value(spark, S.memory_label(F.lit("best_of_month"))) == "best of month"
    assert [value(spark, S.retry_delay_seconds(F.lit(k))) for k in (1, 2)] == [60, 120]
    assert value(spark, S.has_camera_data(F.lit(""), F.lit(0))) is False
    assert value(spark, S.has_camera_data(F.lit(""), F.lit(200))) is True


@pytest.mark.parametrize(("day", "label"), [("2024-01-30", "Today"), ("2024-01-29", "Yesterday"), ("2000-01-15", "January 15, 2000"), ("unknown", "Unknown date")])
def test_day_label(spark, day, label):
    assert value(spark, S.day_label(F.lit(day), "2024-01-30")) == label


def test_position(spark):
    at = lambda a, b: value(spark, S.has_position(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [at(0, 0), at(0, 5), at(None, 5), at(1, 1)] == [False, True, False, True]


def test_clamp(spark):
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x1", -5), ("y1", 2), ("x2", 20), ("y2", 9))])
    assert tuple(value(spark, S.clamp_box(box, F.lit(10), F.lit(8)))) == (0, 2, 10, 8)
    assert value(spark, S.clamp_box(box, F.lit(10), F.lit(1))) is None
