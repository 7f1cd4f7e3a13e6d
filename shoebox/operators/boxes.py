"""Detections: suppression of overlaps and merging of text boxes, as folds over each image's ordered boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def as_box(c: Column) -> Column:
    return F.struct(*[c[k].cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])


def suppress(detections: DataFrame, most: float = 0.4, image: str = "photo", min_score: float | None = None) -> DataFrame:
    """image, rank, box, score: by falling score, each box that overlaps no kept one by more than `most`."""
    rows = detections if min_score is None else detections.where(F.col("score") >= min_score)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), as_box(F.col("bbox")).alias("box"))))
    start = F.lit(None).cast(f"array<struct<box:{_BOX},score:double>>")
    start = F.coalesce(start, F.expr(f"cast(array() AS array<struct<box:{_BOX},score:double>>)"))

    def fold(kept: Column, d: Column) -> Column:
        hit = F.exists(kept, lambda k: S.iou(k["box"], d["box"]) > most)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(F.struct(d["box"].alias("box"), (-d["minus"]).cast("double").alias("score")))))

    kept = rows.groupBy(image).agg(ranked.alias("d")).select(image, F.aggregate("d", start, fold).alias("kept"))
    return kept.select(image, F.posexplode("kept").alias("rank", "k")).select(image, "rank", "k.box", "k.score")


def merge_text_boxes(boxes: DataFrame, image: str = "photo", order: str = "pos") -> DataFrame:
    """image, n, boxes: in order, a box that starts within 5 of the last one's right edge and 10 of its rows widens it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), as_box(F.col("bbox")).alias("box")))), lambda s: s["box"])
    start = F.expr(f"cast(array() AS array<{_BOX}>)")

    def fold(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (b["x1"] <= last["x2"] + 5) & (b["y1"] >= last["y1"] - 10) & (b["y1"] <= last["y2"] + 10)
        wide = F.struct(F.least(last["x1"], b["x1"]).alias("x1"), F.least(last["y1"], b["y1"]).alias("y1"), F.greatest(last["x2"], b["x2"]).alias("x2"), F.greatest(last["y2"], b["y2"]).alias("y2"))
        return F.when(F.size(done) == 0, F.array(b)).when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(done, F.array(b)))

    safe = lambda done, b: F.when(F.size(done) == 0, F.array(b)).otherwise(fold(done, b))
    out = boxes.groupBy(image).agg(ordered.alias("b")).select(image, F.aggregate("b", start, safe).alias("boxes"))
    return out.select(image, F.size("boxes").alias("n"), "boxes")


def clamped(detections: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Detections cut to their image, without those that lie outside."""
    return detections.withColumn("bbox", S.clamp_box(as_box(F.col("bbox")), F.col(width), F.col(height))).where(F.col("bbox").isNotNull())
