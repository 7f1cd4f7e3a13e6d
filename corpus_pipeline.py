"""From documents to packed training sequences, in five stages.

Each stage takes what its predecessor left, written as Parquet and read again. All but the last return the columns of
documents. A verdict belongs to a row by its doc_id (null included) and text, so that rows without an id, and rows that
share one, are judged each. Other columns than doc_id and text are carried along, whatever their names; empty tables give
empty results. Texts may have any length that a Spark string has, and null counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from shoebox.llm import exact_dedup, packing, quality_classifier, simhash, suffix_dedup
from shoebox.llm.common import held_out, materialise, read_table, scratch, sieve, text_of

#: No SQL: the classifier is fitted, fingerprints and tokens need code. tests/llm/test_pipeline.py compares each stage of
#: run() with a brute-force version.
ORACLE_SQL = None
_KEY, _ID, _SAME = "_stage_text_key", "_stage_id", "_stage_same"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with their doc_id as a long and a 64-bit hash of their text."""
    return docs.withColumns({_ID: F.col("doc_id").cast("bigint"), _KEY: F.xxhash64(text_of())})


def _met(rows: DataFrame, keys: DataFrame, how: str, key: str = _KEY) -> DataFrame:
    """rows joined with keys (and what else they carry) by doc_id, null included, and another key."""
    right = keys.withColumnsRenamed({_ID: f"{_ID}_", key: f"{key}_"})
    return rows.join(right, F.col(_ID).eqNullSafe(F.col(f"{_ID}_")) & (F.col(key) == F.col(f"{key}_")), how)


def _kept(docs: DataFrame, verdicts: DataFrame, same: str) -> DataFrame:
    """One row of docs for each doc_id and text that verdicts (a row for each of docs: doc_id, text_hash, same, kept) keep.

    same: what texts that count as equal share. Most documents are kept and occur once: they pass a sieve and do not move.
    Of rows that agree in doc_id and `same` the least, by what can be ordered, stays.
    """
    found = verdicts.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_KEY), F.col(same).alias(_SAME), "kept")
    groups = found.groupBy(_ID, _SAME).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("NOT _kept OR _n > 1")
    touched = materialise(_met(found, groups, "inner", _SAME).select(_ID, _KEY, _SAME, "_kept").distinct())
    clear, rest = sieve(_keyed(docs), touched, _ID, _KEY)
    rest = _met(rest, touched, "left").where("coalesce(_kept, true)").withColumn(_SAME, F.coalesce(_SAME, F.col(_KEY).cast("string")))
    ordered = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    once = rest.groupBy(_ID, _SAME).agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("_row")).select("_row.*")
    return clear.select(*docs.columns).union(once)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier scores below 0.5."""
    scores = quality_classifier.quality_scores(docs, read_table(spark, sf_dir, "labels"), ~held_out(3, 1))
    bad = materialise(scores.where("predicted = 0").select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_KEY)).distinct())
    clear, rest = sieve(_keyed(docs), bad, _ID, _KEY)
    return clear.union(_met(rest, bad, "left_anti")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the least doc_id, null last."""
    return _kept(docs, exact_dedup.exact_dedup(docs), "text_sha256")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that links of five-word Jaccard similarity 0.8 or more join: the least doc_id, null last.

    Links are found by the SimHash shards of operator 5 and confirmed by the sets of shingles.
    """
    return _kept(docs, simhash.near_copies(docs), "sha256")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier; n_chars (if there) follows. Every row stays.

    Where a cut leaves part of a character, that part goes too. Rows that agree in doc_id and text all get what is left of
    the first.
    """
    cut = materialise(suffix_dedup.cut_texts(docs).select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_KEY), F.col("text").alias("_left"), "n_removed"))
    clear, rest = sieve(_keyed(docs), materialise(cut.where("n_removed > 0").select(_ID, _KEY).distinct()), _ID, _KEY)
    first = cut.groupBy(_ID, _KEY).agg(F.min_by("_left", "n_removed").alias("_left"))
    rest = _met(rest, first, "left")
    left = F.col("_left")
    changed = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(left.isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clear.select(*docs.columns).union(rest.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
