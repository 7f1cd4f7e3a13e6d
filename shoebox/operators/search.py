"""Hybrid search requests: text to vector, exact or inverted-file neighbours, merged with text matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .enrich import encode
from .vectors import knn


def semantic_search(queries: DataFrame, corpus: DataFrame, make_encoder: Callable, k: int = 20, id: str = "vec_id", vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """query, id, score, rank for queries (query long, text); blank ones have no rows."""
    asked = queries.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    vectors = encode(asked, make_encoder, "text", "_vector").select(F.col("query").alias(id), F.col("_vector").alias(vector))
    return knn(vectors, corpus, k, id, vector, min_score)
