"""The kept vector index: changes, compaction, partition pruning, recall."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import vectors
from shoebox.operators.vector_index import VectorIndex
from shoebox.plans import index as plans

SCHEMA = "vec_id string, embedding array<float>"


def axis(dim, k, x=1.0):
    return [x if j == k else 0.0 for j in range(dim)]


def test_changes_one_by_one(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    found = lambda v, k=5, **a: [(r.id, round(r.score, 6)) for r in index.search(df(("q", v)), k, **a).orderBy("rank").collect()]
    assert found(axis(4, 0)) == [] and index.rows() is None
    index.delete(df(("none", None)))
    index.upsert(df(("none", None), ("short", [])))
    assert found(axis(4, 0)) == []
    index.upsert(df(("p1", axis(4, 1))))
    assert found(axis(4, 1)) == [("p1", 1.0)]
    index.upsert(df(("close", axis(4, 0)), ("far", [0.1, 0.9, 0.0, 0.0]), ("odd", [1.0]), (None, axis(4, 0))))
    assert [i for i, _ in found(axis(4, 0), 2)] == ["close", "far"]
    index.upsert(df(("p1", axis(4, 2))))  # replaced
    assert dict(found(axis(4, 1)))["p1"] == 0.0
    index.delete(df(("close", None), ("unknown", None)))
    assert "close" not in dict(found(axis(4, 0)))
    index.compact()
    assert len(index._log()) == 1
    index.upsert(df(("far", None)))  # a vector that cannot be used deletes
    assert sorted(r.id for r in index.rows().collect()) == ["p1"]
    index.upsert(df(("close", axis(4, 0)), ("close", axis(4, 3))))  # of one batch the greatest counts
    assert found(axis(4, 0), 1) == [("close", 1.0)]
    index.compact()
    index.delete(df(("p1", None), ("close", None)))
    assert found(axis(4, 0)) == []


def test_only_probed_lists_are_read(spark, tmp_path):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    rows = [(str(k), (centres[k % 12] + 0.1 * r.normal(size=16)).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.upsert(df.where("vec_id < '5'"))
    index.upsert(df.where("vec_id >= '5'"))
    index.delete(df.where("vec_id like '%7'"))
    probes, compared = index.tune(5)
    assert probes <= 4 and compared <= 225
    out = index.search(df.where("vec_id = '10'"), 5)
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan.replace("isnotnull(list", "list#") or "list#" in plan.split("PartitionFilters")[1][:200]
    keyed = df.where("vec_id not like '%7'").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    exact = {x.id for x in vectors.knn(keyed.where("vec_id = 10"), keyed, 5).collect()}
    assert len({int(x.id) for x in out.collect()} & exact) >= 4
    # Only files of some lists stand behind the result.
    lists = index.live().select("list").distinct().count()
    used = {p.split("list=")[1].split("/")[0] for p in index.live("code", lists=[r[0] for r in index.live().where("id = '10'").select("list").collect()]).inputFiles()}
    assert len(used) <= lists  # files are chosen by the partition filter when the plan runs
    assert index.live("code", lists=[0]).select("list").distinct().count() <= 1


@pytest.mark.parametrize("sf", ["0.1"])
def test_recall_over_the_final_rows(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    if not os.path.exists(sf_dir):
        pytest.skip("no data")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    final = e.where("vec_id % 10 <> 2").withColumn("embedding", F.when(F.col("vec_id") % 10 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    asked = e.where("vec_id % 50 = 0")
    exact = {(r.query, r.id) for r in vectors.knn(asked, final, 10).collect()}
    index = plans.changed_index(spark, sf_dir)
    assert index._log()[-1].compared < final.count() / 4
    found = {(r.query, r.id) for r in index.search(asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    index.compact()
    assert {(r.query, r.id) for r in index.search(asked, 10).collect()} == found


def test_search_by_codes_on_the_embeddings(spark):
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.exists(sf_dir):
        pytest.skip("no data")
    from shoebox.plans import search

    exact = {(x.query, x.id) for x in search.knn_exact(spark, sf_dir).collect()}
    found = {(x.query, x.id) for x in plans.index_search(spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_bins_of_lists_return_few_rows_without_vectors(spark, tmp_path):
    """Of each bin a query gets `most` rows at most, whatever the number of lists; and those are the best by codes."""
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, r.normal(size=8).tolist()) for k in range(900)], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "bins"))
    index.upsert(rows)
    asked = index._usable(rows.where("vec_id % 100 = 0"))
    found = index._scored(asked, 1 << 30, 5, index._log())
    assert "asked" not in found.columns
    best = found.collect()
    every = index._scored(asked, 1 << 30, 900, index._log()).collect()
    assert len(every) == 9 * 900 and {(x.query, x.id) for x in best} == {(x.query, x.id) for x in every if x.place <= 5}
    assert all(x.nth == y.nth for x in best for y in every if (x.query, x.id) == (y.query, y.id))
