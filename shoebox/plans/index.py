"""Queries of the kept indexes: vectors of `embeddings`, texts of `documents`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from .base import Plans, table

PLANS = Plans()


def changed_index(spark, sf_dir) -> VectorIndex:
    """Built on two thirds of the rows; then the rest comes, some vectors change, some rows go, and the index is compacted between."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    index.upsert(e.where("vec_id % 3 <> 0"))
    index.upsert(e.where("vec_id % 3 = 0"))
    index.compact()
    index.upsert(e.where("vec_id % 10 = 1").withColumn("embedding", F.reverse("embedding")))
    index.delete(e.where("vec_id % 10 = 2"))
    index.tune(10)
    return index


@PLANS.add()
def index_upserts(spark, sf_dir):
    """tests/test_vector_index.py holds this against the exact search over the rows that remain."""
    index = changed_index(spark, sf_dir)
    return index.search(table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@PLANS.add("""
    SELECT vec_id AS id, len(embedding) AS n, CASE WHEN vec_id % 10 = 1 THEN embedding[len(embedding)] ELSE embedding[1] END::DOUBLE AS first,
        CASE WHEN vec_id % 10 = 1 THEN embedding[1] ELSE embedding[len(embedding)] END::DOUBLE AS last
    FROM embeddings WHERE vec_id % 10 <> 2""")
def index_rows(spark, sf_dir):
    return changed_index(spark, sf_dir).rows().select("id", F.size("vector").alias("n"), F.element_at("vector", 1).alias("first"), F.element_at("vector", -1).alias("last"))


@PLANS.add()
def index_search(spark, sf_dir):
    """The nearest rows of every fiftieth by product-quantised codes, then in full."""
    e = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    index.upsert(e)
    index.tune(10)
    return index.search(e.where("vec_id % 50 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


TERMS = ("license", "http://", "Quality", "ow the", "z")


@PLANS.add(" UNION ALL ".join(f"SELECT '{t}' AS term, doc_id FROM documents WHERE contains(lower(coalesce(text, '')), '{t.strip().lower()}')" for t in TERMS))
def text_index_search(spark, sf_dir):
    """Substrings of whole texts through one index; the last is too short for it and scans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex(spark, f"{shared_folder(spark).rstrip('/')}/texts-{uuid.uuid4().hex}").build(docs, "doc_id", "text")
    found = [index.search(docs, t, "doc_id", "text").select(F.lit(t).alias("term"), "doc_id") for t in TERMS]
    return reduce(DataFrame.union, found)
