"""Library queries: views, timelines, albums, memories, tags, access and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rounds import materialise

# Columns of the photo view and their names there.
VIEW = {
    "id": "id", "name": "name", "file": "file", "thumbnail": "thumbnail", "type": "type", "taken_at": "takenAt", "width": "width", "height": "height", "size": "size",
    "mime_type": "mimeType", "description": "description", "is_favorite": "isFavorite", "trashed_at": "trashedAt", "duration": "duration", "live_photo_pair_id": "livePhotoPairId",
    "search_text": "searchText", "location": "location", "latitude": "latitude", "longitude": "longitude", "perceptual_hash": "perceptualHash", "ml_status": "mlStatus",
    "camera_make": "cameraMake", "camera_model": "cameraModel", "lens_model": "lensModel", "iso": "iso", "aperture": "aperture", "focal_length": "focalLength", "owner": "owner",
    "created": "created", "updated": "updated",
}
# Settings and their defaults.
SETTINGS = {"ocr_enabled": True, "min_face_score": 0.7, "max_face_distance": 0.6, "min_faces": 3, "poll_interval_secs": 30, "batch_size": 8}


def photo_view(media: DataFrame) -> DataFrame:
    return media.select(*[F.col(a).alias(b) for a, b in VIEW.items()])


def first_per_id(rows: DataFrame, order: str, id: str = "id") -> DataFrame:
    """The first row of each id by order; rows without an id are left out."""
    n = F.row_number().over(W.partitionBy(id).orderBy(order))
    return rows.where(F.col(id).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def photo_views(rows: DataFrame, order: str) -> DataFrame:
    """First row of each id, and only then without the trashed ones."""
    return first_per_id(rows, order).where("trashed_at IS NULL")


def in_section(section: str = "all") -> Column:
    """Condition of a library section: favourites, trash, or everything that is not in the trash."""
    kept = F.col("trashed_at").isNull()
    return {"favorites": kept & F.coalesce("is_favorite", F.lit(False)), "trash": ~kept}.get(section, kept)


def matches_text(query: str, *columns: str, ocr: str | None = None) -> Column:
    """Whether any of the columns contains the trimmed query, whatever its case; a blank query matches nothing."""
    q = query.strip().lower()
    if not q:
        return F.lit(False)
    out = F.lit(False)
    for c in [*columns, *([ocr] if ocr else [])]:
        out |= F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return out


def timeline(media: DataFrame, today: str, id: str = "id", at: str = "taken_at") -> DataFrame:
    """date, label, n, newest (its latest photo) for each day, latest day first; undated photos come before all.

    A day's photos are rows of timeline_rows(), not a list: no day is gathered into one row or task.
    """
    out = media.groupBy(S.day_key(F.col(at)).alias("date")).agg(F.count("*").alias("n"), F.max_by(id, F.struct(at, id)).alias("newest"))
    return out.select("date", S.day_label(F.col("date"), today).alias("label"), "n", "newest").orderBy(F.desc("date"))


def timeline_rows(media: DataFrame, today: str, id: str = "id", at: str = "taken_at") -> DataFrame:
    """media with date and label, in the order of the timeline; sorted by range over all tasks."""
    out = media.withColumn("date", S.day_key(F.col(at)))
    return out.withColumn("label", S.day_label(F.col("date"), today)).orderBy(F.desc("date"), F.desc(at), id)


def neighbours(media: DataFrame, by: str, id: str = "id", at: str = "taken_at") -> DataFrame:
    """id, previous, next in the order of falling time within `by`.

    Rows are sorted by range over all tasks, so that no `by` is gathered into one; each task looks beyond its borders, of
    which the driver holds two rows for each task.
    """
    order = [F.col(by), F.desc(at), F.col(id)]
    n = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = media.select(by, id, at).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = materialise(rows.select(F.col(by).alias("by"), F.col(id).alias("id"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    ends = rows.groupBy("task").agg(*[f(F.struct("by", "id"), "at").alias(c) for c, f in (("first", F.min_by), ("last", F.max_by))])
    ends = sorted(ends.collect(), key=lambda r: r["task"])
    before = {b["task"]: tuple(a["last"]) for a, b in zip(ends, ends[1:], strict=False)}
    after = {a["task"]: tuple(b["first"]) for a, b in zip(ends, ends[1:], strict=False)}
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("by", "id")}

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, task = None, None, None

        def out(batch: pa.RecordBatch, follows: tuple | None) -> pa.RecordBatch:
            nonlocal last
            groups, ids = batch.column("by").to_pylist(), batch.column("id").to_pylist()
            around = [last, *zip(groups, ids, strict=True), follows]
            pick = lambda x, g: x[1] if x is not None and x[0] == g else None
            last = around[-2]
            columns = [pa.array([pick(x, g) for x, g in zip(side, groups, strict=True)], batch.schema.field("id").type) for side in (around[:-2], around[2:])]
            return pa.RecordBatch.from_arrays([batch.column("by"), batch.column("id"), *columns], ["by", "id", "previous", "next"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                task = batch.column("task")[0].as_py()
                last = before.get(task)
            else:
                yield out(held, (batch.column("by")[0].as_py(), batch.column("id")[0].as_py()))
            held = batch
        if held is not None:
            yield out(held, after.get(task))

    found = rows.select("by", "id", "task").mapInArrow(link, f"by {kinds['by']}, id {kinds['id']}, previous {kinds['id']}, next {kinds['id']}")
    return found.select(F.col("by").alias(by), F.col("id").alias(id), "previous", "next")


def changed(versions: DataFrame, id: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the previous version's; first versions count as changed."""
    w = W.partitionBy(id).orderBy(order)
    return versions.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_first")


def album_counts(albums: DataFrame, items: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """albums with item_count, zero-filled; given media, trashed photos don't count."""
    own = items if media is None else items.join(media.where("trashed_at IS NULL").select(F.col("id").alias("photo")), "photo", "left_semi")
    n = own.groupBy(F.col("album").alias("id")).agg(F.count("*").alias("item_count"))
    return albums.join(n, "id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def album_photos(items: DataFrame, media: DataFrame) -> DataFrame:
    """album, sort_order and the photo's columns: each photo of an album once, at its first place, not trashed."""
    first = items.groupBy("album", F.col("photo").alias("id")).agg(F.min("sort_order").alias("sort_order"))
    return first.join(media.where("trashed_at IS NULL"), "id").orderBy("album", "sort_order", "id")


def with_related(left: DataFrame, key: str, right: DataFrame, id: str = "id", name: str | None = None) -> DataFrame:
    """left with the related row nested; null where there is none."""
    nested = right.select(F.col(id).alias(key), F.struct(*right.columns).alias(name or f"{key}_row"))
    return left.join(nested, key, "left")


def memory_feed(memories: DataFrame, items: DataFrame, media: DataFrame) -> DataFrame:
    """Memories, newest first, with the ids of their photos in the order they were added; missing photos are dropped."""
    own = items.join(media.select(F.col("id").alias("photo")), "photo", "left_semi")
    lists = own.groupBy(F.col("memory").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("created", "photo"))), lambda s: s["photo"]).alias("photos"))
    out = memories.join(lists, "id", "left").withColumn("photos", F.coalesce("photos", F.expr("array()").cast(lists.schema["photos"].dataType)))
    return out.orderBy(F.desc("created"), "id")


def tags_of(item_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return item_tags.select("item", F.col("tag").alias("id")).distinct().join(tags, "id")


def with_tags(media: DataFrame, item_tags: DataFrame, wanted: list, all_of: bool = False) -> DataFrame:
    """Media with any, or with all, of the wanted tags."""
    own = item_tags.where(F.col("tag").isin(*wanted)).select(F.col("item").alias("id"), "tag")
    if all_of:
        own = own.groupBy("id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(wanted)))
    return media.join(own.select("id"), "id", "left_semi")


def tag_suggestions(tags: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return tags.where(F.lower("name").contains(q)).orderBy("name", "id")


def can_create_tag(tags: DataFrame, query: str) -> DataFrame:
    """One row: can_create, true if no tag has the name, whatever its case."""
    q = query.strip().lower()
    return tags.agg((~F.coalesce(F.bool_or(F.lower("name") == q), F.lit(False)) & F.lit(bool(q))).alias("can_create"))


def tag_paths(tags: DataFrame) -> DataFrame:
    """id, path, depth of every tag below a root, through parent, however deep; tags of a cycle have no path.

    Every tag knows the names up to an ancestor, and that ancestor what lies above it, so a round doubles the way that is
    known. Once a round brings no further tag to its root, the others hang below cycles or missing tags.
    """
    known = materialise(tags.select("id", F.col("parent").alias("up"), F.col("name").cast("string").alias("path"), F.lit(0).alias("depth")))
    reached = -1
    while (now := known.where("up IS NULL").count()) > reached:
        reached = now
        above = known.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("begin"), F.col("depth").alias("above"))
        way = known.where("up IS NOT NULL").join(above, "up").select("id", F.col("further").alias("up"), F.concat("begin", F.lit("/"), "path").alias("path"), (F.col("depth") + F.col("above") + 1).alias("depth"))
        known = materialise(known.where("up IS NULL").union(way))
    return known.where("up IS NULL").select("id", "path", "depth")


def visible_to(rows: DataFrame, membership: DataFrame, user, org: str = "org") -> DataFrame:
    """Rows whose org has the user as a member."""
    return rows.join(membership.where(F.col("user") == user).select(F.col("org").alias(org)), org, "left_semi")


def visible_children(children: DataFrame, key: str, parents: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose parent row is visible."""
    return children.join(parents.select(F.col(id).alias(key)), key, "left_semi")


def hybrid(library: DataFrame, semantic: DataFrame, text_hits: DataFrame, id: str = "id", by_score: bool = False) -> DataFrame:
    """library rows with slot: semantic hits (0) in library or score order, then hits by text alone (1).

    Without semantic hits these are the text hits. Order by slot, then (by_score) falling score, then falling taken_at, id.
    """
    near = semantic.groupBy(id).agg(F.max("score").alias("score"))
    first = library.join(near, id).withColumn("slot", F.lit(0))
    second = text_hits.join(near, id, "left_anti").withColumn("score", F.lit(None).cast("double")).withColumn("slot", F.lit(1))
    order = [F.col("slot"), *([F.desc("score")] if by_score else []), F.desc("taken_at"), F.col(id)]
    return first.unionByName(second, allowMissingColumns=True).orderBy(*order)


def reorder(items: DataFrame, order: DataFrame) -> DataFrame:
    """items with the sort_order that order (id, sort_order) gives them; others keep theirs."""
    order = order.groupBy("id").agg(F.min("sort_order").alias("_new"))
    return items.join(order, "id", "left").withColumn("sort_order", F.coalesce("_new", "sort_order")).drop("_new")


def update(rows: DataFrame, ids: list, id: str = "id", **values: Column) -> DataFrame:
    """rows with columns set for the given ids."""
    return rows.withColumns({c: F.when(F.col(id).isin(*ids), v).otherwise(F.col(c)) for c, v in values.items()})


def file_reference(media: DataFrame) -> DataFrame:
    return media.select("id", "file", F.nullif("thumbnail", F.lit("")).alias("thumbnail"))


def with_defaults(settings: DataFrame) -> DataFrame:
    """One row of settings, with the defaults where it, or a value, is missing."""
    base = settings.sparkSession.range(1).select(F.lit(1).alias("_k"))
    own = settings.limit(1).select(F.lit(1).alias("_k"), *[c for c in settings.columns if c in SETTINGS])
    return base.join(own, "_k", "left").select(*[F.coalesce(F.col(c) if c in settings.columns else F.lit(None), F.lit(v)).alias(c) for c, v in SETTINGS.items()])


def settings_of(orgs: DataFrame, settings: DataFrame, org: str = "org") -> DataFrame:
    """One row of settings for each org, with the defaults where its row, or a value of it, is missing."""
    own = settings.select(org, *[c for c in settings.columns if c in SETTINGS])
    return orgs.select(org).distinct().join(own, org, "left").select(org, *[F.coalesce(F.col(c) if c in settings.columns else F.lit(None), F.lit(v)).alias(c) for c, v in SETTINGS.items()])


def patch(old: DataFrame, new: DataFrame, key: str, always: tuple[str, ...] = ()) -> DataFrame:
    """old with new's values where they are set (text not empty, number positive); columns in always are overwritten."""
    types = dict(new.dtypes)

    def value(c: str) -> Column:
        if c == key or c not in types:
            return F.col(c)
        v = F.col(f"_new.{c}")
        if c in always:
            return F.when(F.col("_new").isNotNull(), v).otherwise(F.col(c)).alias(c)
        if types[c] == "string":
            v = F.nullif(v, F.lit(""))
        elif types[c] in ("int", "bigint"):
            v = F.when(v > 0, v)
        elif c in ("latitude", "longitude"):
            v = F.nullif(v, F.lit(0.0))
        return F.coalesce(v, F.col(c)).alias(c)

    joined = old.join(new.select(key, F.struct(*new.columns).alias("_new")), key, "left")
    return joined.select(*[value(c) for c in old.columns])
