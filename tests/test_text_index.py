"""Trigram search against the scan."""

import random

import pytest

from shoebox.operators import library
from shoebox.operators.text_index import TextIndex, grams_of

SCHEMA = "id string, name string, description string, gram long, n long"


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    r = random.Random(1)
    words = ["beach", "Sunset", "été", "ÇELİK", "mountain", "a", "ab", "dog's", "日本語の写真", "x" * 3000, "", "100%"]
    rows = [(str(k), " ".join(r.choice(words) for _ in range(3)), None if k % 7 == 0 else " ".join(r.choice(words) for _ in range(k % 5)), 1, 2) for k in range(400)]
    rows += [("needle", "a needle in the hay", "", 0, 0), (None, "needle", "", 0, 0), ("needle", "same id, no match", None, 0, 0), ("split", "nee", "dle", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df, TextIndex(spark, str(tmp_path_factory.mktemp("text"))).build(df, "id", "name", "description")


@pytest.mark.parametrize("query", ["beach", " SUNSET ", "é", "ab", "needle", "nee", "日本語", "写真", "zzzz", "g's", "%", "", "  ", "çelik", "x" * 50, "beach sunset", "%"])
def test_same_rows_as_the_scan(media, query):
    df, index = media
    want = sorted((r.id, r.name) for r in df.where("id IS NOT NULL").where(library.matches_text(query, "name", "description")).collect())
    assert sorted((r.id, r.name) for r in index.search(df, query, "id", "name", "description").collect()) == want


def test_few_rows_are_candidates(media, spark):
    df, index = media
    assert [r.id for r in index.candidates("needle").collect()] == ["needle"] and index.candidates("ne") is None
    plan = index.candidates("needle")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan.replace(" ", "") and len(grams_of("aaaa")) == 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = TextIndex(spark, index.path + "-docs").build(docs, "doc_id", "text")
    word = docs.selectExpr("explode(split(lower(text), '[^a-z]+')) w").where("length(w) = 14").groupBy("w").count().orderBy("count", "w").first().w
    n = docs.where(library.matches_text(word, "text")).count()
    assert 0 < n <= whole.candidates(word).count() < docs.count() / 10


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    index = TextIndex(spark, str(tmp_path / "t")).build(df, "id", "name")
    assert index.search(df, "needle", "id", "name").count() == 0
