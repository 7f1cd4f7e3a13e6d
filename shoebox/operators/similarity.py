"""Near-duplicate groups of perceptual hashes: exact candidate keys, greedy leaders in parallel rounds, image hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rounds import apart, components, materialise, until_stable

#: Edges of a component that one task scans; it holds them as pairs of numbers.
LOCAL_EDGES = 1 << 20
#: Rows of a join key beyond which they are dealt to groups, rows of a group, neighbours that a node looks at.
CROWD, GROUP, LISTED = 256, 2048, 4


def _masks(nodes: DataFrame, blocks: int) -> list[int]:
    """The 64 bits in `blocks` masks of about equal information: bits by how evenly they are set, dealt out back and forth.

    Bits that (almost) all hashes share are spread over the blocks, so that they crowd no key.
    """
    bit = lambda k: F.avg(F.shiftright(F.col("hi" if k < 32 else "lo"), 31 - k % 32).bitwiseAND(1))
    share = nodes.agg(*[bit(k).alias(f"b{k}") for k in range(64)]).first()
    even = sorted(range(64), key=lambda k: (round(abs((share[k] or 0) - 0.5), 3), k))
    masks = [0] * blocks
    for n, k in enumerate(even):
        lap, place = divmod(n, blocks)
        masks[place if lap % 2 == 0 else blocks - 1 - place] |= 1 << (63 - k)
    return masks


class Keys:
    """Join keys of an exact Hamming join: of t + agree blocks of bits, hashes within t bits agree in at least `agree`, so
    every choice of that many blocks is a key. A pair belongs to the first choice it agrees on, and comes out there only."""

    def __init__(self, masks: list[int], t: int, agree: int):
        self.masks, self.t, self.choices = masks, t, list(combinations(range(t + agree), agree))
        self.wanted = [sum(masks[k] for k in c) for c in self.choices]
        self.before = [[masks[k] for k in range(c[-1]) if k not in c] for c in self.choices]  # blocks that must differ

    def sent(self, rows: DataFrame) -> DataFrame:
        """rows once for each choice n, with the bits they must agree in."""
        own = lambda m: F.struct(F.col("hi").bitwiseAND(m >> 32).alias("khi"), F.col("lo").bitwiseAND(m & 0xFFFFFFFF).alias("klo"))
        return rows.select("*", F.posexplode(F.array(*[own(m) for m in self.wanted])).alias("n", "key")).select(*rows.columns, "n", "key.*")

    def first(self, n: np.ndarray | int, x: np.ndarray) -> np.ndarray:
        """Whether choice n is the first that pairs of hashes with this exclusive or agree on."""
        ok = np.ones(len(x), bool)
        for m in self.before[n]:
            ok &= (x & np.uint64(m)) != 0
        return ok

    def first_column(self, xhi, xlo):
        """The same as a Column, over column n."""
        out = F.lit(None).cast("boolean")
        for k in reversed(range(len(self.choices))):
            ok = F.lit(True)
            for m in self.before[k]:
                ok = ok & (xhi.bitwiseAND(m >> 32).bitwiseOR(xlo.bitwiseAND(m & 0xFFFFFFFF)) != 0)
            out = F.when(F.col("n") == k, ok).otherwise(out)
        return out


def _words(table: pa.Table) -> np.ndarray:
    return (table.column("hi").to_numpy().astype(np.uint64) << np.uint64(32)) | table.column("lo").to_numpy().astype(np.uint64)


def _compared(keys: Keys, most: int | None):
    """Close pairs of the rows that may lead (a) with those that are open (b), of two groups of a key; `most` lowest a for each b."""

    def run(table: pa.Table) -> pa.Table:
        n, i, j = (table.column(c)[0].as_py() for c in ("n", "i", "j"))
        own = table.column("own").to_numpy()
        ords, words, may, open_ = table.column("ord").to_numpy(), _words(table), table.column("may").to_numpy(), table.column("open").to_numpy()
        found = []
        for g, h in [(i, j)] if i == j else [(i, j), (j, i)]:
            low, high = np.flatnonzero((own == g) & may), np.flatnonzero((own == h) & open_)
            low = low[np.argsort(ords[low], kind="stable")]
            for at in range(0, len(high), 256):
                some = high[at : at + 256]
                x = words[some][:, None] ^ words[low][None]
                d = np.bitwise_count(x)
                r, c = np.nonzero((d <= keys.t) & (ords[low][None] < ords[some][:, None]))
                keep = keys.first(n, x[r, c])
                r, c = r[keep], c[keep]
                if most is not None and len(r):
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c = r[place < most], c[place < most]
                found.append((ords[low[c]], ords[some[r]], d[r, c].astype(np.int32)))
        a, b, d = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or [[]] * 3))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.int32())})

    return run


def _pairs(rows: DataFrame, keys: Keys, most: int | None = None, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """a, b, distance with a < b for rows (scope, ord, hi, lo, may, open): may holds of a, open of b.

    Keys of more than `crowd` rows, counted first, are dealt to groups of about `group` rows, and every pair of groups is a
    task's; with most, it returns the `most` lowest a for each b. Rows of other keys meet in a join.
    """
    sent = keys.sent(rows.select("scope", "ord", "hi", "lo", "may", "open"))
    key = ["scope", "n", "khi", "klo"]
    crowded = materialise(sent.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).withColumn("groups", F.ceil(F.col("rows") / F.lit(group)).cast("int")))
    some = not crowded.isEmpty()
    plain = sent.join(crowded.select(*key), key, "left_anti") if some else sent
    right = plain.where("open").select(*key, F.col("ord").alias("b"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    met = plain.where("may").join(apart(right), key).where(F.col("ord") < F.col("b"))
    d = S.hamming((F.col("hi"), F.col("lo")), (F.col("hi2"), F.col("lo2"))).alias("distance")
    met = met.where(d <= keys.t).where(keys.first_column(F.col("hi").bitwiseXOR(F.col("hi2")), F.col("lo").bitwiseXOR(F.col("lo2"))))
    found = met.select(F.col("ord").alias("a"), "b", d.cast("int").alias("distance"))
    if some:
        dealt = sent.join(crowded, key).withColumn("own", F.pmod(F.xxhash64("ord"), "groups").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, groups - 1)")))
        dealt = dealt.select(*key, "ord", "hi", "lo", "may", "open", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        found = found.union(dealt.groupBy(*key, "i", "j").applyInArrow(_compared(keys, most), "a long, b long, distance int"))
    return found


def hash_pairs(hashes: DataFrame, t: int, agree: int = 2, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """a, b, distance with a < b for rows (scope, ord, hi, lo) of one scope whose hashes differ in at most t bits, once each.

    More blocks that must agree make longer keys, so fewer candidates, and more copies of each row.
    """
    rows = hashes.withColumns({"may": F.lit(True), "open": F.lit(True)})
    return _pairs(rows, Keys(_masks(hashes, t + agree), t, agree), None, crowd, group)


def _settled(first: dict[int, list[tuple[int, bool]]], most: int) -> list[tuple[int, int | None]]:
    """(node, leader) of the nodes whose lists settle them, in order; lists hold their lowest rivals and whether these lead already."""
    state: dict[int, int | None] = {}  # leader of a settled node, None while it stays open
    for node in sorted(first):
        own = sorted(first[node])
        for other, leads in own:
            at = other if leads else state.get(other, other if other not in first else None)
            if at is None or at == other:  # open, or a leader
                state[node] = at
                break
        else:
            state[node] = node if len(own) < most else None
    return [(k, v) for k, v in state.items() if v is not None]


def hash_leaders(nodes: DataFrame, t: int, agree: int = 2, most: int = LISTED, local: int = LOCAL_EDGES, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """node, leader: what a scan by ord gives where each unvisited hash leads and takes the later unvisited ones within t bits.

    nodes: scope, ord (unique), hi, lo, distinct hashes of a scope. A node looks at its `most` lowest neighbours that are not
    members of others: if the lowest of them leads, it is a member of that one; if there is none, it leads; if all are members by
    now and there may be more, it looks again. So no list of all pairs is ever written. Lists of up to `local` rows in all are
    settled in one task, longer ones in rounds.
    """
    keys = Keys(_masks(nodes, t + agree), t, agree)
    state = materialise(nodes.select("scope", "ord", "hi", "lo", F.lit(None).cast("bigint").alias("leader")))
    while True:
        rows = state.where("leader IS NULL OR leader = ord").withColumns({"may": F.lit(True), "open": F.col("leader").isNull()})
        found = _pairs(rows, keys, most, crowd, group)
        lowest = F.row_number().over(W.partitionBy("b").orderBy("a"))
        lists = found.select("a", "b").withColumn("place", lowest).where(F.col("place") <= most)
        leads = state.where("leader = ord").select(F.col("ord").alias("a"), F.lit(True).alias("leads"))
        lists = materialise(lists.join(apart(leads), "a", "left").select("b", "a", F.coalesce("leads", F.lit(False)).alias("leads")))
        n = lists.count()
        settled = (_by_list if n <= local else _by_rounds_of_lists)(lists, most) if n else None
        free = state.where("leader IS NULL").select("ord").join(apart(lists.select(F.col("b").alias("ord")).distinct()), "ord", "left_anti") if n else state.where("leader IS NULL").select("ord")
        new = free.select(F.col("ord").alias("node"), F.col("ord").alias("new"))
        new = new.union(settled) if n else new
        state = materialise(state.join(apart(new), state["ord"] == new["node"], "left").select("scope", "ord", "hi", "lo", F.coalesce("leader", "new").alias("leader")))
        if state.where("leader IS NULL").isEmpty():
            return state.select(F.col("ord").alias("node"), "leader")


def _by_list(lists: DataFrame, most: int) -> DataFrame:
    def scan(table: pa.Table) -> pa.Table:
        first: dict[int, list[tuple[int, bool]]] = {}
        for b, a, leads in zip(*(table.column(c).to_pylist() for c in ("b", "a", "leads")), strict=True):
            first.setdefault(b, []).append((a, leads))
        out = _settled(first, most)
        return pa.table({"node": pa.array([k for k, _ in out], pa.int64()), "new": pa.array([v for _, v in out], pa.int64())})

    return lists.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(scan, "node long, new long")


def _by_rounds_of_lists(lists: DataFrame, most: int) -> DataFrame:
    """All nodes look at their lists at once, until nothing changes."""
    own = lists.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    other = lists.select(F.col("a").alias("node"), "leads").groupBy("node").agg(F.max("leads").alias("leads"))
    state = own.join(apart(other), "node", "full").select("node", F.when(F.col("n").isNull(), F.col("node")).when(F.col("leads"), F.col("node")).alias("leader"), "n")
    # a node without a list leads, or has led before
    state = materialise(state)
    while True:
        at = lists.join(apart(state.select(F.col("node").alias("a"), F.col("leader").alias("at"))), "a")
        look = at.where("at IS NULL OR at = a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "at")).alias("low"))
        new = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("low").isNotNull(), F.col("low.at")).when(F.col("n") < most, F.col("node"))
        after = materialise(state.join(apart(look), "node", "left").select("node", new.alias("leader"), "n", F.col("leader").isNull().alias("was_open")))
        if after.where("was_open AND leader IS NOT NULL").isEmpty():
            return after.where("n IS NOT NULL AND leader IS NOT NULL").select("node", F.col("leader").alias("new"))
        state = after.drop("was_open")


def _scan(frame: pd.DataFrame) -> pd.DataFrame:
    """node, leader of one component (a, b: its edges) by the scan itself."""
    later: dict[int, list[int]] = {}
    for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
        later.setdefault(a, []).append(b)
    leader: dict[int, int] = {}
    for node in sorted({*later, *frame["b"].tolist()}):
        if node not in leader:
            leader[node] = node
            for other in later.get(node, ()):
                leader.setdefault(other, node)
    return pd.DataFrame({"node": list(leader), "leader": list(leader.values())}, dtype="int64")


def greedy_leaders(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """node, leader: what a scan in order gives where each unvisited node leads and takes its later unvisited neighbours.

    nodes: node, unique and ordered; edges: a < b. Components are independent: those of up to `local` edges are scanned each
    in a task. In larger ones all nodes decide in rounds: an undecided node with a lower leader becomes a member; one whose
    lower neighbours are all members becomes a leader. There are as many rounds as the scan's longest chain of decisions.
    """
    edges = materialise(edges.select("a", "b"))
    root = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    edges = materialise(edges.join(apart(root.select(F.col("u").alias("b"), "root")), "b").select("root", "a", "b"))  # b is never its component's least
    sizes = edges.groupBy("root").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > local).select("root"))
    some_large = not large.isEmpty()
    small = edges.join(large, "root", "left_anti") if some_large else edges
    led = small.groupBy("root").applyInPandas(_scan, "node long, leader long")
    if some_large:
        led = led.union(_by_rounds(edges.join(large, "root", "left_semi").select("a", "b")))
    return nodes.select("node").join(apart(led), "node", "left").select("node", F.coalesce("leader", "node").alias("leader"))


def _by_rounds(edges: DataFrame) -> DataFrame:
    edges = materialise(edges)
    touched = edges.select(F.col("b").alias("node")).distinct()
    start = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(apart(touched.withColumn("t", F.lit(1))), "node", "left")
    start = materialise(start.select("node", F.when(F.col("t").isNull(), F.lit("leader")).otherwise(F.lit("open")).alias("state")))

    def step(s: DataFrame) -> DataFrame:
        lower = edges.join(apart(s.select(F.col("node").alias("a"), F.col("state").alias("of"))), "a").groupBy("b").agg(F.max((F.col("of") == "leader").cast("int")).alias("led"), F.min((F.col("of") == "member").cast("int")).alias("all_members"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("led") == 1, "member").when(F.col("all_members") == 1, "leader").otherwise("open")
        return s.join(apart(lower.withColumnRenamed("b", "node")), "node", "left").select("node", new.alias("state"))

    state = until_stable(start, step, lambda s: s.where("state = 'open'").limit(1).count())
    leaders = state.where("state = 'leader'").select(F.col("node").alias("a"))
    first = edges.join(apart(leaders), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    return state.join(apart(first), "node", "left").select("node", F.when(F.col("state") == "leader", F.col("node")).otherwise(F.col("leader")).alias("leader"))


def duplicate_groups(media: DataFrame, t: int = 5, id: str = "id", hash: str = "perceptual_hash", order: str = "ord", scope: str | None = "org", exclude_trashed: bool = False) -> DataFrame:
    """id, leader_id, position, group_size, distance for the members of groups of two or more.

    Rows are scanned by `order` (unique); malformed or unset hashes take no part. distance is that between the leader and the
    group's last member. Equal hashes are one node while groups form, so copies cost nothing.
    """
    hi, lo = S.hash_halves(F.col(hash))
    rows = media.where(F.col("trashed_at").isNull()) if exclude_trashed else media
    rows = rows.select(F.col(id).alias("id"), F.col(order).cast("long").alias("ord"), (F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")).alias("scope"), hi.alias("hi"), lo.alias("lo"))
    rows = materialise(rows.where("hi IS NOT NULL"))
    nodes = materialise(rows.groupBy("scope", "hi", "lo").agg(F.min("ord").alias("ord")))
    led = hash_leaders(nodes, t)
    nodes = nodes.join(apart(led), nodes["ord"] == led["node"]).select("scope", "hi", "lo", "leader")
    members = rows.join(apart(nodes), ["scope", "hi", "lo"])
    sizes = members.groupBy("leader").agg(F.count("*").alias("group_size"), F.max_by(F.struct("hi", "lo"), "ord").alias("last")).where("group_size > 1")
    first = rows.select(F.col("ord").alias("leader"), F.col("id").alias("leader_id"), F.struct("hi", "lo").alias("first"))
    sizes = sizes.join(apart(first), "leader")
    distance = S.hamming((F.col("first.hi"), F.col("first.lo")), (F.col("last.hi"), F.col("last.lo")))
    return members.join(apart(sizes.select("leader", "leader_id", "group_size", distance.alias("distance"))), "leader").select("id", "leader_id", (F.col("ord") == F.col("leader")).alias("leads"), "group_size", "distance")


def without_duplicates(media: DataFrame, groups: DataFrame, id: str = "id") -> DataFrame:
    """media without the members of duplicate_groups() that do not lead."""
    return media.join(apart(groups.where(~F.col("leads")).select(F.col("id").alias(id))), id, "left_anti")


#: Cosines of a pixel hash are whole numbers of 2^-15: sums are exact, so that ties do not hang on how an engine rounds.
COSINE = 1 << 15


def dct_hash(grey: np.ndarray) -> int:
    """64-bit hash of a grey image of whole numbers below 2^18: its 8 x 8 lowest frequencies above their median."""
    y = np.linspace(0, grey.shape[0] - 1, 64).round().astype(int)
    x = np.linspace(0, grey.shape[1] - 1, 64).round().astype(int)
    n = np.arange(64)
    basis = np.round(COSINE * np.cos(np.pi * (2 * n[None, :] + 1) * n[:8, None] / 128)).astype(np.int64)
    low = (basis @ grey.astype(np.int64)[np.ix_(y, x)] @ basis.T).ravel()
    return int("".join("1" if v else "0" for v in 2 * low > np.sort(low)[31:33].sum()), 2)


def hash_images(images: DataFrame) -> DataFrame:
    """path, perceptual_hash, error over Spark's image source (struct column `image`); unreadable images get an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, h, w, c, data in frame.itertuples(index=False):
                if h is None or h <= 0 or not data:
                    out.append((path, None, "undecodable"))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.int64)
                grey = pixels[:, :, 0] if c == 1 else pixels[:, :, :3] @ np.array([114, 587, 299])  # thousandths
                out.append((path, f"p:{dct_hash(grey):016x}", None))
            yield pd.DataFrame(out, columns=["path", "perceptual_hash", "error"])

    rows = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    return rows.mapInPandas(run, "path string, perceptual_hash string, error string")
