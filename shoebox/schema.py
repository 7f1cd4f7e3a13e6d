"""Row types of the media tables and what every reader does with unset values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables' columns.
TABLES = {
    "media": "id string, org string, owner string, name string, file string, thumbnail string, type string, taken_at timestamp, width long, height long, size long, mime_type string, description string, is_favorite boolean, trashed_at timestamp, duration long, live_photo_pair_id string, search_text string, location string, latitude double, longitude double, smart_search_vector array<float>, perceptual_hash string, ml_status string, camera_make string, camera_model string, lens_model string, iso long, aperture string, focal_length string, created timestamp, updated timestamp",
    "albums": "id string, name string, description string, cover_photo string, org string, owner string, created timestamp, updated timestamp",
    "album_items": "id string, album string, photo string, sort_order long, created timestamp",
    "tags": "id string, name string, color string, parent string, org string, owner string, created timestamp, updated timestamp",
    "item_tags": "id string, item string, tag string, created timestamp",
    "people": "id string, name string, thumbnail_face string, is_hidden boolean, birth_date timestamp, color string, org string, owner string, created timestamp, updated timestamp",
    "faces": "id string, photo string, person string, bounding_box struct<x1:float,y1:float,x2:float,y2:float>, embedding array<float>, image_width long, image_height long, source_type string, is_visible boolean, created timestamp, updated timestamp",
    "memories": "id string, type string, title string, data string, owner string, created timestamp, updated timestamp",
    "memory_items": "id string, memory string, photo string, created timestamp",
    "jobs": "id string, photo string, job_type string, status string, attempts long, last_error string, scheduled_at timestamp, created_at timestamp",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def unset_to_null(df: DataFrame) -> DataFrame:
    """Empty texts become null, and a position of exactly (0, 0) becomes no position."""
    out = df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])
    if {"latitude", "longitude"} <= set(df.columns):
        nowhere = (F.col("latitude") == 0) & (F.col("longitude") == 0)
        out = out.withColumns({c: F.when(~F.coalesce(nowhere, F.lit(False)), F.col(c)) for c in ("latitude", "longitude")})
    return out
