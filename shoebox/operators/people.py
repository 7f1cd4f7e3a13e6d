"""Faces into people: assignment, re-clustering, merge and split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import apart, components, materialise, roots, until_stable
from .vectors import close_pairs, least_offers, nearest_offers

TAU = 0.6
#: Links of a component whose merges one task replays.
LOCAL_LINKS = 1 << 16


def _faces(faces: DataFrame, scope: str | None) -> DataFrame:
    """id, ord, person, vector, scope, zero of the visible faces that have a vector."""
    rows = faces.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    if "is_visible" in faces.columns:
        rows = rows.where(F.coalesce("is_visible", F.lit(True)))
    return rows.select("id", F.col("ord").cast("long").alias("ord"), F.nullif(F.col("person").cast("string"), F.lit("")).alias("person"), "vector", (F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")).alias("scope"), (~F.exists("vector", lambda x: x != 0)).alias("zero"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the class of their vector, and classes (cls, scope, vector, assigned: the least assigned ord).

    Equal vectors are at distance 0, so a class acts through its least rows and copies make no pairs. A zero vector is at
    distance 1 from its own copies: each such row is a class of its own.
    """
    own = F.when(F.col("zero"), F.col("ord")).otherwise(F.lit(-1))
    reps = rows.groupBy("scope", "vector", own.alias("alone")).agg(F.min("ord").alias("cls"), F.min(F.when(F.col("person").isNotNull(), F.col("ord"))).alias("assigned"))
    reps = materialise(reps)
    key = [F.xxhash64("vector").alias("hash"), "scope", "vector"]  # the hash first, so that a sort seldom compares vectors
    members = rows.select("id", "ord", "person", own.alias("alone"), *key).join(apart(reps.select(*key, "alone", "cls")), ["hash", "scope", "vector", "alone"])
    members = materialise(members.select("id", "ord", "person", "cls"))
    return members, reps.select("cls", "scope", "vector", "assigned")


def _assign(members: DataFrame, classes: DataFrame, tau: float, among: DataFrame) -> DataFrame:
    """id, ord, person (old), root for members: among has the new faces that may join (id) and are joined by later ones."""
    new = members.where("person IS NULL").join(among.select("id"), "id", "left_semi")
    low = new.groupBy("cls").agg(F.min("ord").alias("low"))
    offers = materialise(classes.join(low, "cls", "left"))
    own = new.join(offers.select("cls", "assigned", "low"), "cls").withColumn("parent", F.least("assigned", F.when(F.col("low") < F.col("ord"), F.col("low"))))
    first = own.where("parent IS NULL").select("ord", "cls")  # of each class without an assigned face the earliest new one
    asking = offers.select(F.col("cls").alias("id"), "vector", "scope", F.when(F.col("assigned").isNull(), F.col("low")).alias("asks"), F.col("assigned").alias("fixed"), F.col("low").alias("early"))
    across = nearest_offers(asking, tau, scope="scope").select(F.col("id").alias("cls"), "offer")
    parents = own.where("parent IS NOT NULL").select("ord", "parent").union(first.join(across, "cls", "left").select("ord", F.coalesce("offer", "ord")))
    fixed = members.where("person IS NOT NULL").select("ord", F.col("ord").alias("parent"))
    root = roots(parents.union(fixed).toDF("node", "parent"))
    return members.join(root, members["ord"] == root["node"]).select("id", "ord", "person", "root")


def _named(found: DataFrame, members: DataFrame) -> DataFrame:
    heads = members.select(F.col("ord").alias("root"), F.col("person").alias("root_person"), F.col("id").alias("root_face"))
    return found.join(heads, "root").select("id", "ord", F.coalesce("person", "root_person", F.concat(F.lit("new:"), F.col("root_face").cast("string"))).alias("person"), F.coalesce("person", "root_person").isNull().alias("founded"), "root_face")


def assign_faces(faces: DataFrame, tau: float = TAU, scope: str | None = None, min_faces: int = 0) -> DataFrame:
    """id, ord, person, founded, root_face: every face's person.

    In the order of ord, an unassigned face joins the person of its nearest face at distance below tau among assigned faces
    and earlier ones (tie: the earlier), or founds one, named after it, with it as thumbnail. Faces of new people with
    fewer than min_faces members stay out.
    """
    rows = materialise(_faces(faces, scope))
    members, classes = _classes(rows)
    out = _named(_assign(members, classes, tau, members), members)
    if min_faces > 1:
        small = out.where("founded").groupBy("person").count().where(F.col("count") < min_faces)
        out = out.join(small, "person", "left_anti").select("id", "ord", "person", "founded", "root_face")
    return out


def new_people(assigned: DataFrame) -> DataFrame:
    """One row for each founded person: person, name, thumbnail_face, faces."""
    return assigned.where("founded").groupBy("person").agg(F.lit("Unknown").alias("name"), F.first("root_face").alias("thumbnail_face"), F.count("*").alias("faces"))


def assign_known(faces: DataFrame, tau: float = TAU, scope: str | None = None) -> DataFrame:
    """id, ord, person (null: stays unassigned): as assign_faces, but no one is founded.

    A face takes part once a taking-part face within tau is assigned or earlier than it; among those the nearest decides.
    """
    rows = materialise(_faces(faces, scope))
    members, classes = _classes(rows)
    new = materialise(members.where("person IS NULL").select("id", "ord", "cls"))
    low = F.when(F.col("assigned").isNotNull(), F.lit(-1)).cast("long")
    start = materialise(classes.select("cls", low.alias("low"), low.alias("from"), low.isNotNull().alias("moved")))

    def step(state: DataFrame) -> DataFrame:
        """Lows that moved are offered to the classes that are not within tau of an assigned face yet; lows only fall, so earlier offers stay."""
        asking = classes.select("cls", "vector", "scope").join(apart(state), "cls").withColumn("asks", F.coalesce(F.col("from") != -1, F.lit(True))).where("asks OR moved")
        offers = least_offers(asking.select(F.col("cls").alias("id"), "vector", "scope", "asks", F.when(F.col("moved"), F.col("low")).alias("low")), tau, scope="scope")
        state = materialise(state.join(apart(offers), state["cls"] == offers["id"], "left").select("cls", "low", F.least("from", "offer").alias("from")))
        entered = new.join(apart(state), "cls").where("ord > from").groupBy("cls").agg(F.min("ord").alias("enter"))
        state = state.join(apart(entered), "cls", "left").withColumn("new", F.least("low", "enter"))
        return state.select("cls", F.col("new").alias("low"), F.least("from", "new").alias("from"), (~F.col("low").eqNullSafe(F.col("new"))).alias("moved"))

    def open_(state: DataFrame) -> bool:
        """Whether a low moved and a class is left that may still hear of it."""
        return not state.where("moved").isEmpty() and not state.where("from IS NULL OR from <> -1").isEmpty()

    state = until_stable(start, step, open_)
    inside = new.join(apart(state.select("cls", "from")), "cls").where("ord > from").select("id")
    found = _assign(members, classes, tau, materialise(inside))
    heads = members.select(F.col("ord").alias("root"), F.col("person").alias("root_person"))
    named = found.join(heads, "root").select("ord", F.coalesce("person", "root_person").alias("person"))
    return members.select("id", "ord").join(named, "ord", "left").select("id", "ord", "person")


def replay_merges(n: list[int], edges: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
    """(scanned, met, source, target) merges of people 0.. with n faces each, scanned in order over the sparse close pairs (j > i).

    The larger of the two stays; the scanned one's size grows by what it meets, its own centroid stays as it was.
    """
    name, size, gone, out = list(range(len(n))), list(n), set(), []
    for i in range(len(n)):
        if name[i] in gone:
            continue
        for j in sorted(edges.get(i, ())):
            if name[j] in gone:
                continue
            a, b = name[i], name[j]
            source, target = (a, b) if size[j] > size[i] else (b, a)
            name[i] = target
            size[i] += size[j]
            if source != target:
                gone.add(source)
                out.append((i, j, source, target))
    return out


def _replay_local(table: pa.Table) -> pa.Table:
    """The merges of one component from its edges."""
    ends = [table.column(c).to_pylist() for c in ("i", "io", "n_i", "j", "jo", "n_j")]
    people = {o: (k, n) for which in (0, 3) for k, o, n in zip(*ends[which : which + 3], strict=True)}
    ords = sorted(people)
    at = {o: k for k, o in enumerate(ords)}
    edges: dict[int, list[int]] = {}
    for low, high in zip(ends[1], ends[4], strict=True):
        edges.setdefault(at[low], []).append(at[high])
    out = replay_merges([people[o][1] for o in ords], edges)
    columns = zip(*[(ords[i], ords[j], people[ords[x]][0], people[ords[y]][0]) for i, j, x, y in out], strict=True) if out else [[]] * 4
    return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("step", "met", "source", "target"), columns, strict=True)})


def _scan_ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each scanned person (rows by i and jo, its later neighbours) does; holds one person's name and size."""
    at, name, size = None, 0, 0
    for batch in batches:
        out = []
        for i, io, n, j, jo, m in zip(*(batch.column(c).to_pylist() for c in ("i", "io", "n_i", "j", "jo", "n_j")), strict=True):
            if i != at:
                at, name, size = i, i, n
            source, target = (name, j) if m > size else (j, name)
            name, size = target, size + m
            out.append((io, jo, source, target))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["step", "met", "source", "target"])


_MERGES = "step long, met long, source long, target long"


def _replay_rounds(edges: DataFrame) -> DataFrame:
    """Merges of large components. A person is scanned once no earlier one within two links is open: then nothing that is still to
    come can change its neighbours. Scanned and absorbed people and their links leave the graph."""
    live, found = materialise(edges.select("i", "io", "n_i", "j", "jo", "n_j")), None
    while not live.isEmpty():
        both = live.select(F.col("i").alias("u"), F.col("io").alias("uo"), F.col("j").alias("v"), F.col("jo").alias("vo"))
        both = both.union(both.select("v", "vo", "u", "uo"))
        one = both.groupBy("u", "uo").agg(F.min("vo").alias("m")).select("u", "uo", F.least("uo", "m").alias("m"))
        two = both.join(one.select(F.col("u").alias("v"), F.col("m").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        ready = one.join(two, "u").where((F.col("uo") == F.col("m")) & (F.col("uo") == F.col("far"))).select(F.col("u").alias("i"))
        scans = live.join(ready, "i").repartition("i").sortWithinPartitions("i", "jo")
        merges = materialise(scans.mapInArrow(_scan_ready, _MERGES))
        found = merges if found is None else found.union(merges)
        out = materialise(ready.union(merges.select("source")).distinct())
        live = live.join(out, "i", "left_anti").join(out.select(F.col("i").alias("j")), "j", "left_anti")
        live = materialise(live.select("i", "io", "n_i", "j", "jo", "n_j"))
    return found


def merge_plan(centroids: DataFrame, tau: float = TAU, scope: str | None = None, local: int = LOCAL_LINKS) -> DataFrame:
    """scope, step, met, source, target: the greedy merges of people (person, ord, n, centroid) of each scope.

    In the order of step, then met: the ords of the scanned person and of the one it met. Merges never leave a connected
    component of the close pairs: components of up to `local` links are replayed each in a task, larger ones by rounds.
    """
    rows = materialise(centroids.select("person", F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n"), F.col("centroid").alias("vector"), (F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")).alias("scope")))
    # People of different scopes may share an ord, and are different nodes.
    rows = materialise(rows.withColumn("node", F.monotonically_increasing_id()))
    pairs = materialise(close_pairs(rows.select(F.col("node").alias("id"), "vector", "scope"), tau, scope="scope").select("a", "b"))
    root = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    end = lambda c: rows.select(F.col("node").alias(c), F.col("ord").alias(f"{c}o"), F.col("n").alias(f"n_{c}"))
    links = pairs.join(end("a"), "a").join(end("b"), "b").join(root.select(F.col("u").alias("b"), "root"), "b", "left")
    links = links.join(root.select(F.col("u").alias("a"), F.col("root").alias("root_a")), "a", "left").withColumn("root", F.coalesce("root", "root_a", "a"))
    first = F.col("ao") < F.col("bo")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    links = materialise(links.select("root", pick("a", "b").alias("i"), pick("ao", "bo").alias("io"), pick("n_a", "n_b").alias("n_i"), pick("b", "a").alias("j"), pick("bo", "ao").alias("jo"), pick("n_b", "n_a").alias("n_j")))
    large = materialise(links.groupBy("root").agg(F.count("*").alias("links")).where(F.col("links") > local).select("root"))
    some = not large.isEmpty()
    small = links.join(large, "root", "left_anti") if some else links
    found = small.groupBy("root").applyInArrow(_replay_local, _MERGES)
    if some:
        found = found.union(_replay_rounds(links.join(large, "root", "left_semi")))
    who = lambda c: rows.select(F.col("node").alias(c), F.col("person").alias(f"{c}_person"))
    named = found.join(rows.select(F.col("node").alias("source"), "scope", F.col("person").alias("source_person")), "source").join(who("target"), "target")
    return named.select("scope", "step", "met", F.col("source_person").alias("source"), F.col("target_person").alias("target"))


def final_names(merges: DataFrame) -> DataFrame:
    """source, target with chains of merges followed to their end. Each source is merged once; no cycles."""
    nodes = merges.select(F.col("source").alias("node"), F.col("target").alias("parent"))
    tops = merges.select(F.col("target").alias("node")).distinct().join(merges.select(F.col("source").alias("node")), "node", "left_anti")
    return roots(nodes.union(tops.select("node", F.col("node").alias("parent")))).where("node <> root").select(F.col("node").alias("source"), F.col("root").alias("target"))


def merge_people(faces: DataFrame, people: DataFrame, merges: DataFrame, org: str = "org") -> tuple[DataFrame, DataFrame]:
    """Faces relabelled and people without the merged ones; merges across orgs are ignored."""
    owner = people.select(F.col("id").alias("source"), F.col(org).alias("_a")), people.select(F.col("id").alias("target"), F.col(org).alias("_b"))
    allowed = merges.join(owner[0], "source").join(owner[1], "target").where(F.col("_a") == F.col("_b")).select("source", "target")
    final = materialise(final_names(allowed))
    named = faces.join(final.select(F.col("source").alias("person"), F.col("target").alias("_to")), "person", "left")
    named = named.select(*[F.coalesce("_to", "person").alias("person") if c == "person" else F.col(c) for c in faces.columns])
    return named, people.join(final.select(F.col("source").alias("id")), "id", "left_anti")


def split_person(faces: DataFrame, people: DataFrame, person: str, face_ids: DataFrame, new_person: str, name: str = "Unknown") -> tuple[DataFrame, DataFrame]:
    """The listed faces (face_ids: id) of `person` move to a new one that keeps its other columns; unknown ids are skipped."""
    moved = face_ids.select("id").distinct().withColumn("_move", F.lit(True))
    out = faces.join(moved, "id", "left")
    out = out.select(*[F.when(F.col("_move") & (F.col("person") == person), F.lit(new_person)).otherwise(F.col(c)).alias(c) if c == "person" else F.col(c) for c in faces.columns])
    fresh = people.where(F.col("id") == person).withColumn("id", F.lit(new_person)).withColumn("name", F.lit(name))
    return out, people.unionByName(fresh)


def recluster(faces: DataFrame, tau: float = TAU, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces (id, ord, person) after assign_known and the greedy merge of close people; and counts attempted, assigned, merged."""
    rows = materialise(_faces(faces, scope))
    known = materialise(assign_known(faces, tau, scope))
    named = rows.drop("person", "ord").join(known, "id").where("person IS NOT NULL")
    means = named.select("scope", "person", F.posexplode("vector").alias("pos", "x")).groupBy("scope", "person", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    means = means.groupBy("scope", "person").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    order = named.groupBy("scope", "person").agg(F.min("ord").alias("ord"))
    merges = materialise(merge_plan(means.join(order, ["scope", "person"]), tau, "scope").select("source", "target"))
    final = final_names(merges)
    out = known.join(final.select(F.col("source").alias("person"), F.col("target").alias("_to")), "person", "left").select("id", "ord", F.coalesce("_to", "person").alias("person"))
    before = rows.where("person IS NULL").select("id")
    counts = known.join(before, "id").agg(F.count("*").alias("attempted"), F.count("person").alias("assigned")).withColumn("merged", F.lit(merges.count()))
    return out, counts


def person_media(faces: DataFrame, media: DataFrame, person: str | int, org: str = "org") -> DataFrame:
    """The org's photos with a face of the person, once each, not trashed."""
    own = faces.where(F.col("person") == person).select(F.col("photo").alias("id"))
    return media.where(F.col("trashed_at").isNull()).join(own, "id", "left_semi")


def media_per_person(faces: DataFrame, people: DataFrame) -> DataFrame:
    n = faces.where("person IS NOT NULL").groupBy(F.col("person").alias("id")).agg(F.count_distinct("photo").alias("photo_count"))
    return people.join(n, "id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))


def people_with_thumbnails(people: DataFrame, faces: DataFrame, media: DataFrame) -> DataFrame:
    """Visible people with the photo, file and thumbnail of their face; null where any is missing."""
    shown = people.where(~F.coalesce("is_hidden", F.lit(False)))
    face = faces.select(F.col("id").alias("thumbnail_face"), F.col("photo").alias("thumbnail_photo_id"))
    photo = media.select(F.col("id").alias("thumbnail_photo_id"), F.col("file").alias("thumbnail_photo_file"), F.nullif("thumbnail", F.lit("")).alias("thumbnail_photo_thumb"))
    return shown.join(face, "thumbnail_face", "left").join(photo, "thumbnail_photo_id", "left").select(*people.columns, "thumbnail_photo_id", "thumbnail_photo_file", "thumbnail_photo_thumb")
