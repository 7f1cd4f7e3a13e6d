"""Scalar functions of the media domain, Column in and Column out, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Known file extensions and their media types.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "tiff": "image/tiff", "tif": "image/tiff",
    "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "avi": "video/x-msvideo", "mkv": "video/x-matroska",
}
IMAGE_MIMES = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/heic", "image/heif", "image/avif", "image/tiff")
VIDEO_MIMES = ("video/mp4", "video/quicktime", "video/webm", "video/x-msvideo", "video/x-matroska")


def blank_to_null(c: Column) -> Column:
    """Unset text is an empty string in the source and null here."""
    return F.nullif(c, F.lit(""))


def has_position(lat: Column, lon: Column) -> Column:
    """Both coordinates known and not exactly (0, 0)."""
    return F.coalesce((lat != 0) | (lon != 0), F.lit(False)) & lat.isNotNull() & lon.isNotNull()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where either vector has no length."""
    return 1 - cosine_similarity(a, b)


def hash_halves(hash_text: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a 'p:' + 16 hex digits perceptual hash; null where it is malformed."""
    good = F.when(hash_text.rlike("^p:[0-9a-fA-F]{16}$"), hash_text)
    return F.conv(F.substring(good, 3, 8), 16, 10).cast("bigint"), F.conv(F.substring(good, 11, 8), 16, 10).cast("bigint")


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(h, F.lit(1.0))
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; 0 where they do not overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    union = area(a) + area(b) - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise((w * h).cast("double") / F.nullif(union, F.lit(0)))


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """The part of the box inside the image; null where nothing is left."""
    x1, y1 = F.greatest(box["x1"], F.lit(0.0)), F.greatest(box["y1"], F.lit(0.0))
    x2, y2 = F.least(box["x2"], width.cast("double")), F.least(box["y2"], height.cast("double"))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def thumbnail_size(width: Column, height: Column, longest: Column) -> tuple[Column, Column]:
    """Integer size whose longer edge is at most `longest`; sizes that fit stay."""
    w, h, m = width.cast("bigint"), height.cast("bigint"), longest.cast("bigint")
    per = lambda a, b: F.floor((a * m - F.pmod(a * m, F.nullif(b, F.lit(0)))) / F.nullif(b, F.lit(0))).cast("bigint")
    fits = F.greatest(w, h) <= m
    return F.when(fits, w).when(w >= h, m).otherwise(per(w, h)), F.when(fits, h).when(w >= h, per(h, w)).otherwise(m)


def thumbnail_needed(width: Column, height: Column, longest: Column, mime: Column) -> Column:
    return (F.greatest(width, height) > longest) & ~mime.isin("image/avif", "image/tiff")


def media_type(mime: Column) -> Column:
    return F.when(F.startswith(mime, F.lit("video/")), "video").otherwise("image")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def mime_from_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(table[file_extension(name)], F.lit("application/octet-stream"))


def is_supported_image(mime: Column) -> Column:
    return mime.isin(*IMAGE_MIMES)


def is_supported_video(mime: Column) -> Column:
    return mime.isin(*VIDEO_MIMES)


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def aperture_text(x: Column) -> Column:
    return F.format_string("f/%.1f", x.cast("double"))


def focal_text(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x >= 100, F.format_string("%.0fmm", x)).otherwise(F.format_string("%.1fmm", x))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def day_key(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("unknown"))


def day_label(key: Column, today: str) -> Column:
    """Today, Yesterday or a long date for a day key, seen from the day `today` (yyyy-MM-dd)."""
    day, now = F.try_to_date(key, "yyyy-MM-dd"), F.to_date(F.lit(today))
    return F.when(day.isNull(), "Unknown date").when(day == now, "Today").when(day == F.date_sub(now, 1), "Yesterday").otherwise(F.date_format(day, "MMMM d, yyyy"))


def byte_size_text(n: Column) -> Column:
    """1536 -> '1.5 KB': base 1024, one decimal without a trailing zero, up to GB."""
    n = n.cast("bigint")
    unit = F.when(n < 1024, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    scale = F.when(n < 1024, 1).when(n < 1 << 20, 1024).when(n < 1 << 30, 1 << 20).otherwise(1 << 30).cast("bigint")
    tenths = F.floor((20 * n + scale) / (2 * scale)).cast("bigint")
    number = F.when(F.pmod(tenths, F.lit(10)) == 0, F.floor(tenths / 10).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("0 B")).otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def place_text(city: Column, state: Column, country: Column) -> Column:
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(state), blank_to_null(country))


def lenient_number(text: Column) -> Column:
    """A plain decimal; anything else, the empty text included, is 0."""
    return F.coalesce(F.when(text.rlike(r"^-?[0-9]*\.?[0-9]*$"), text).try_cast("double"), F.lit(0.0))


def retry_delay_seconds(attempts: Column) -> Column:
    """60, 120, ... after the first, second, ... attempt."""
    return (F.pow(F.lit(2.0), attempts) * 30).cast("bigint")


def similarity_text(distance: Column) -> Column:
    return F.concat((100 - distance).cast("string"), F.lit("% similar"))


def count_text(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def memory_label(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def has_camera_data(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(blank_to_null(c.cast("string")), F.lit("0")) != "0"
    return out
