"""The first bytes of files."""

from pyspark.sql import functions as F

from shoebox.sources import exif, heads


def test_folders_of_files(spark, tmp_path):
    files = [("a/x.bin", b"abcdef"), ("b/x.bin", b"xyz"), ("empty", b""), ("b/.hidden", b"no"), ("_tmp/y", b"no"), ("large", b"q" * 300_000)]
    df = spark.createDataFrame([(f, bytearray(c)) for f, c in files], "file string, content binary")
    assert heads.write_files(df, str(tmp_path / "f")) == 6
    for folder in (str(tmp_path / "f"), f"file://{tmp_path}/f", f"file:{tmp_path}/f/"):
        got = {r.path.split("/f/", 1)[1].lstrip("/"): (r.length, bytes(r.head)) for r in heads.read_heads(spark, folder, 4, 2).collect()}
        assert got == {"a/x.bin": (6, b"abcd"), "b/x.bin": (3, b"xyz"), "empty": (0, b""), "large": (300_000, b"qqqq")}
    (tmp_path / "none").mkdir()
    assert heads.read_heads(spark, str(tmp_path / "none")).count() == 0


def test_files_listed_in_tasks(spark, tmp_path, monkeypatch):
    files = [(f"{k % 3}/{k % 2}/{k}.bin", b"x" * k) for k in range(60)] + [("top", b"abc"), ("0/.hidden", b"no"), ("_tmp/y", b"no")]
    heads.write_files(spark.createDataFrame([(f, bytearray(c)) for f, c in files], "file string, content binary"), str(tmp_path / "f"))
    want = sorted((r.path, r.length, bytes(r.head)) for r in heads.read_heads(spark, str(tmp_path / "f"), 4).collect())
    monkeypatch.setattr(heads.HeadsReader, "partitions", None)
    assert sorted((r.path, r.length, bytes(r.head)) for r in heads.listed_heads(spark, str(tmp_path / "f"), 4).collect()) == want
    assert len(want) == 61


def test_rows_open_their_own_files(spark, tmp_path):
    df = spark.createDataFrame([("a/x", bytearray(b"abcdef")), ("b/x", bytearray(b"xyz"))], "file string, content binary")
    heads.write_files(df, str(tmp_path / "f"))
    rows = spark.createDataFrame([(1, "a/x"), (2, "b/x"), (3, "c/x"), (4, None), (5, ""), (6, "a/x")], "id long, file string")
    out = heads.with_heads(rows, spark, str(tmp_path / "f"), n=3)
    assert {r.id: r.head and bytes(r.head) for r in out.collect()} == {1: b"abc", 2: b"xyz", 3: None, 4: None, 5: None, 6: b"abc"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a/x", bytearray(b"abcdef")), ("b/x", bytearray(b"xyz"))], "file string, content binary")
    heads.write_files(df, str(tmp_path / "f"))
    monkeypatch.setattr(heads, "_seen_by_arrow", lambda folder: False)
    rows = spark.createDataFrame([(1, "a/x"), (2, "b/x"), (3, "c/x")], "id long, file string")
    for folder in (str(tmp_path / "f"), f"file://{tmp_path}/f/"):
        assert {r.id: r.head and bytes(r.head) for r in heads.with_heads(rows, spark, folder, n=3).collect()} == {1: b"abc", 2: b"xyz", 3: None}


def test_camera_metadata_needs_the_head_only(spark):
    from shoebox.plans import files

    sf_dir = "/root/testdata/sf0.001"
    whole = files.camera_files(spark, sf_dir).where("camera_make IS NOT NULL")
    assert whole.count() > 50 and whole.where(F.col("bytes") > 2 + exif.EXAMINED).count() > 0
