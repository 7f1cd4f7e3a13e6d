"""Nearest place within a radius, and map clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

CELL, RADIUS_KM, MARGIN = 0.5, 50.0, 1e-6
_AROUND = round(360 / CELL)


def _row(lat: Column) -> Column:
    return F.floor(lat / CELL).cast("int")


def _column(lon: Column) -> Column:
    """Cells count eastwards from 180 degrees west and wrap."""
    return F.pmod(F.floor((lon + 180) / CELL), F.lit(_AROUND)).cast("int")


def _cells(lat: Column, lon: Column, km: float) -> Column:
    """Every cell that the circle's bounding box touches."""
    dlat = F.degrees(F.lit(km / S.EARTH_KM)) + MARGIN
    rows = F.sequence(_row(F.greatest(lat - dlat, F.lit(-90.0))), _row(F.least(lat + dlat, F.lit(90.0))))
    ratio = F.sin(F.lit(km / S.EARTH_KM)) / F.nullif(F.cos(F.radians(lat)), F.lit(0.0))
    pole = (F.abs(lat) + dlat >= 90) | (ratio >= 1) | ratio.isNull()
    dlon = F.degrees(F.asin(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))) + MARGIN
    a, b = F.floor((lon + 180 - dlon) / CELL).cast("int"), F.floor((lon + 180 + dlon) / CELL).cast("int")
    columns = F.when(pole, F.sequence(F.lit(0), F.lit(_AROUND - 1))).otherwise(F.array_distinct(F.transform(F.sequence(a, b), lambda x: F.pmod(x, F.lit(_AROUND)))))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def nearest_place(points: DataFrame, places: DataFrame, id: str = "id", km: float = RADIUS_KM) -> DataFrame:
    """points with city, state, country and distance_km of the nearest place (pos, lat, lon, city, state, country).

    Exactly `km` still counts; ties go to the lower pos. Points without a position, and those with no place near, keep nulls.
    Equal positions are looked up once, so a spot with very many photos costs one search.
    """
    spots = points.where(S.has_position(F.col("latitude"), F.col("longitude"))).select(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).distinct()
    asked = spots.withColumn("cell", F.explode(_cells(F.col("plat"), F.col("plon"), km)))
    kept = places.select("pos", "lat", "lon", "city", "state", "country", F.struct(_row(F.col("lat")).alias("row"), _column(F.col("lon")).alias("col")).alias("cell"))
    d = S.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    near = asked.join(kept, "cell").withColumn("distance_km", d).where(F.col("distance_km") <= km)
    best = near.groupBy("plat", "plon").agg(F.min_by(F.struct("city", "state", "country", "distance_km"), F.struct("distance_km", "pos")).alias("place"))
    out = points.join(best, (F.col("latitude") == F.col("plat")) & (F.col("longitude") == F.col("plon")), "left")
    return out.select(*points.columns, "place.city", "place.state", "place.country", "place.distance_km")


def map_clusters(media: DataFrame, id: str = "id") -> DataFrame:
    """location, n, latitude, longitude, cover: located photos by place text, values of the newest, largest group first."""
    located = media.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.coalesce("location", F.lit("")) != ""))
    newest = F.max_by(F.struct("latitude", "longitude", F.col(id).alias("cover")), F.struct("taken_at", id))
    out = located.groupBy("location").agg(F.count("*").alias("n"), newest.alias("newest"))
    return out.select("location", "n", "newest.latitude", "newest.longitude", "newest.cover").orderBy(F.desc("n"), "location")
