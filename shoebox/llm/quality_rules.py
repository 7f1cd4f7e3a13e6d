"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document's statistics become integers, and these buckets of fixed relative width: numbers below 2**DIGITS stand for
themselves, larger ones keep their leading DIGITS bits. Counts per bucket form a quantile sketch that covers any value and
merges by addition: per (language, source), per language and for all rows. Every group's sketch is blended with that of the
group that holds it, which weighs as much as WEIGHT documents. Limits are the fences Q1 - 3 * IQR and Q3 + 3 * IQR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WEIGHT, DIGITS = 200, 10
#: Limits of so many groups at most are broadcast, so that no document moves to meet them.
GROUPS = 1 << 17
#: metric: (smallest spread between the quartiles, whether a low value is odd too). Units are those of metrics().
SPREADS = {"symbols": (20, False), "dup_lines": (100, False), "word_tenths": (15, True)}
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(words: str, n: str) -> Column:
    """(hash, position) of every 5-word window, sorted; none for fewer than 6 words, which have no two windows."""
    return F.expr(
        f"CASE WHEN {n} < 6 THEN cast(array() AS array<struct<h: bigint, i: int>>) ELSE sort_array(transform(sequence(0, {n} - 5), i -> "
        f"struct(xxhash64({words}[i], {words}[i + 1], {words}[i + 2], {words}[i + 3], {words}[i + 4]) AS h, i AS i))) END"
    )


def _same(a: str, b: str) -> str:
    """Whether the windows at two places of the sorted list are the same five words."""
    return f"_s[{a}].h = _s[{b}].h AND " + " AND ".join(f"_w[_s[{a}].i + {k}] = _w[_s[{b}].i + {k}]" for k in range(5))


def document_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_lines of every whole text.

    Null texts count as empty: all statistics 0. Repeated rows stay repeated. Columns other than `keep` are dropped,
    so clashing names do no harm. A text may have any length that a Spark string has. No shuffle: everything is computed
    where the row is read. Windows of words are brought together by a 64-bit hash and compared word by word.
    """
    t = docs.select(*keep, text_of(text).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(
        *keep,
        words_of(F.col("_t")).alias("_w"),
        (F.length("_t") - F.regexp_count("_t", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    t = t.select(
        *keep, "_w", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").alias("_n"),
    )
    t = t.select(*keep, "_w", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "_n", _windows("_w", "_n").alias("_s"))
    at = F.expr(
        "sort_array(transform(filter(sequence(0, size(_s) - 1), k -> size(_s) > 0 AND "
        f"((k > 0 AND {_same('k', 'k - 1')}) OR (k < size(_s) - 1 AND {_same('k', 'k + 1')}))), k -> _s[k].i))"
    )
    t = t.withColumn("_at", F.when(F.size("_s") > 0, at).otherwise(F.expr("cast(array() AS array<int>)")))
    covered = F.expr("aggregate(_at, named_struct('last', -5, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least(5, x - a.last)), a -> a.n)")
    return t.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(value: str) -> str:
    """The leading DIGITS bits of a number that is not negative."""
    shift = f"greatest(length(bin({value})) - {DIGITS}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def metrics() -> dict[str, Column]:
    """Sketch buckets: symbols per 1000 word characters, repeated lines per 1000 lines, mean word length in tenths."""
    per = lambda a, b, k: F.when(F.col(b) > 0, F.expr(bucket(f"({k} * {a} div {b})"))).otherwise(F.lit(0)).cast("bigint")
    return {"symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "word_tenths": per("word_chars", "n_words", 10)}


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, bucket, n: a sketch of each metric for each group. Sketches merge by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bucket")) for m in SPREADS]))
    return rows.select(*keys, pairs.alias("_p")).groupBy(*keys, "_p.metric", "_p.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


_COUNT = "decimal(38,0)"


def blended(own: DataFrame, above: DataFrame, keys: list[str], held_by: list[str]) -> DataFrame:
    """own sketches plus WEIGHT documents spread like those of the group above, in whole numbers: n * total above + WEIGHT * n above."""
    total = above.groupBy(*held_by, "metric").agg(F.sum("n").cast(_COUNT).alias("t"))
    scaled = own.join(total, [*held_by, "metric"]).select(*keys, "metric", "bucket", (F.col("n") * F.col("t")).cast(_COUNT).alias("n"))
    spread = own.select(*keys, "metric").distinct().join(above, [*held_by, "metric"]).select(*keys, "metric", "bucket", (WEIGHT * F.col("n")).cast(_COUNT).alias("n"))
    return scaled.union(spread).groupBy(*keys, "metric", "bucket").agg(F.sum("n").cast(_COUNT).alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, q1, q3: the least buckets that a quarter, and three quarters, of a group reach.

    A window holds one sketch, whose size is bounded whatever the input: 2**DIGITS buckets and half as many for each
    further bit.
    """
    group = W.partitionBy(*keys, "metric")
    up_to = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    s = sketches.withColumn("total", F.sum("n").over(group)).withColumn("cum", F.sum("n").over(up_to))
    return s.groupBy(*keys, "metric").agg(
        F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )


def fences(limits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, <metric>_low and <metric>_high."""
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*[F.lit(x) for m, (least, _) in SPREADS.items() for x in (m, least)])[F.col("metric")])
    q = limits.withColumn("low", F.col("q1") - 3 * spread).withColumn("high", F.col("q3") + 3 * spread)
    pick = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
    return q.groupBy(*keys).agg(*[pick(m, side) for m in SPREADS for side in ("low", "high")])


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs (doc_id, lang, source, text): statistics, base_failed, kept.

    Null lang or source form groups of their own. Documents on a limit stay. Repeated rows count and come out each. An empty
    table gives an empty result. Every group, of whatever size, has limits of its own.
    """
    rows = document_stats(docs, text)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_{c}")
    rows = materialise(rows.select("doc_id", named("lang"), named("source"), *_STATS, *[c.alias(m) for m, c in metrics().items()], base_failed().alias("base_failed")))
    fine = sketch(rows, ["_lang", "_source"])
    by_lang = merge(fine, ["_lang"])
    pooled = merge(by_lang.withColumn("_all", F.lit(1)), ["_all"])
    by_lang = blended(by_lang, pooled.drop("_all"), ["_lang"], [])
    fine = blended(fine, by_lang, ["_lang", "_source"], ["_lang"])
    found = materialise(fences(quartiles(fine, ["_lang", "_source"]), ["_lang", "_source"]))
    out = rows.join(F.broadcast(found) if found.count() <= GROUPS else found, ["_lang", "_source"])
    inside = F.lit(True)
    for m, (_, low) in SPREADS.items():
        inside &= F.col(m) <= F.col(f"{m}_high")
        if low:
            inside &= F.col(m) >= F.col(f"{m}_low")
    return out.select("doc_id", *_STATS, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
