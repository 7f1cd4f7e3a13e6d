"""Enrichment: ingest defaults, live-photo pairs, thumbnails, encoders and detectors as batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# Longest edge and quality of thumbnails by the org's setting.
THUMBNAILS = {"high": (2048, 92), "optimized": (1024, 75)}


def ingest_defaults(rows: DataFrame, now: str) -> DataFrame:
    """rows with ml_status pending, mime_type from the file's extension, type from it and taken_at now, where unset."""
    mime = F.coalesce(S.blank_to_null(F.col("mime_type")), S.mime_from_name(F.col("file")))
    out = rows.withColumn("mime_type", mime)
    return out.withColumns({
        "ml_status": F.coalesce(S.blank_to_null(F.col("ml_status")), F.lit("pending")),
        "type": F.coalesce(S.blank_to_null(F.col("type")), S.media_type(F.col("mime_type"))),
        "taken_at": F.coalesce("taken_at", F.lit(now).cast("timestamp")),
    })


def live_pairs(media: DataFrame, prefix: bool = False) -> DataFrame:
    """photo, video: still images and films of one org and file stem that belong together.

    A still takes the newest film of its stem, a film the newest HEIC still, or failing that the newest HEIF one. With
    prefix, a stem also matches longer ones that begin with it.
    """
    stem = S.file_stem(F.col("name"))
    still = media.where(F.col("mime_type").isin("image/heic", "image/heif")).select("org", stem.alias("stem"), F.col("id").alias("photo"), F.col("created").alias("made"), (F.col("mime_type") == "image/heic").alias("heic"))
    film = media.where(F.col("mime_type") == "video/quicktime").select("org", stem.alias("stem"), F.col("id").alias("video"), F.col("created").alias("shot"))
    if not prefix:
        met = still.join(film, ["org", "stem"])
    else:
        met = still.join(film.withColumnRenamed("stem", "longer"), "org").where(F.startswith("longer", "stem") | F.startswith("stem", "longer"))
    a = met.withColumn("_n", F.row_number().over(W.partitionBy("photo").orderBy(F.desc("shot"), F.desc("video")))).where("_n = 1").select(F.col("photo").alias("id"), F.col("video").alias("partner"))
    b = met.withColumn("_n", F.row_number().over(W.partitionBy("video").orderBy(F.desc("heic"), F.desc("made"), F.desc("photo")))).where("_n = 1").select(F.col("video").alias("id"), F.col("photo").alias("partner"))
    return a.union(b)


def thumbnail_plan(media: DataFrame, settings: DataFrame) -> DataFrame:
    """id, width, height, quality, needed of each photo's thumbnail, by its org's setting (settings: org, thumbnail_quality)."""
    high = F.coalesce(F.col("thumbnail_quality") == "high", F.lit(False))
    rows = media.join(settings.select("org", "thumbnail_quality"), "org", "left").withColumn("_most", F.when(high, THUMBNAILS["high"][0]).otherwise(THUMBNAILS["optimized"][0]))
    w, h = S.thumbnail_size(F.col("width"), F.col("height"), F.col("_most"))
    return rows.select("id", w.alias("width"), h.alias("height"), F.when(high, THUMBNAILS["high"][1]).otherwise(THUMBNAILS["optimized"][1]).alias("quality"), S.thumbnail_needed(F.col("width"), F.col("height"), F.col("_most"), F.col("mime_type")).alias("needed"))


def ocr_text(media: DataFrame, regions: DataFrame) -> DataFrame:
    """media with search_text followed by the distinct texts of the photo's own regions (photo, pos, text)."""
    own = regions.where(F.coalesce("text", F.lit("")) != "").groupBy(F.col("photo").alias("id")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])).alias("_texts"))
    return media.join(own, "id", "left").withColumn("search_text", F.nullif(F.concat_ws(" ", F.nullif("search_text", F.lit("")), F.concat_ws(" ", "_texts")), F.lit(""))).withColumn("search_text", F.trim("search_text")).drop("_texts")


def encode(df: DataFrame, make_encoder: Callable[[], Callable[[list], np.ndarray]], column: str, out: str = "embedding") -> DataFrame:
    """df with a vector for each value of column. make_encoder() loads the model, once for each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            yield frame.assign(**{out: [v.astype(np.float32) for v in encoder(frame[column].tolist())]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` array<float>")


def detect(df: DataFrame, make_detector: Callable[[], Callable[[list], list]], column: str, id: str = "photo", min_score: float = 0.0) -> DataFrame:
    """id, bbox, score of what a detector (values to lists of (x1, y1, x2, y2, score)) finds at min_score or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for frame in frames:
            rows = [(i, {"x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3]}, b[4]) for i, found in zip(frame[id], detector(frame[column].tolist()), strict=True) for b in found if b[4] >= min_score]
            yield pd.DataFrame(rows, columns=[id, "bbox", "score"])

    return df.select(id, column).mapInPandas(run, f"`{id}` {df.schema[id].dataType.simpleString()}, bbox struct<x1:double,y1:double,x2:double,y2:double>, score double")


def hashing_encoder(dimension: int = 64) -> Callable[[], Callable[[list], np.ndarray]]:
    """A deterministic text encoder: signed feature hashing of lower-cased words, of length 1."""

    def make():
        from hashlib import md5

        known: dict[str, int] = {}

        def one(text) -> np.ndarray:
            v = np.zeros(dimension)
            for w in str(text or "").lower().split():
                if (h := known.get(w)) is None:
                    h = int(md5(w.encode()).hexdigest()[:7], 16)
                    if len(known) < 1 << 18:
                        known[w] = h
                v[h % dimension] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return v / n if n else v

        return lambda values: np.array([one(t) for t in values]).reshape(-1, dimension)

    return make
