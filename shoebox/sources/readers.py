"""Sources and sinks: tables, gazetteers, vocabularies, media files, vector columns and their change logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import schema_of, unset_to_null
from . import heads

#: Bytes of a file that are read at a time, and how many such parts a task reads.
PART, TASK_PARTS = 1 << 20, 64
PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:long,height:long>>,format:struct<duration:string>>"


def scan(df: DataFrame, where: Column | str | None = None, order: list | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows that meet a condition, ordered, from offset on, at most limit of them (0: all)."""
    out = df if where is None else df.where(where)
    out = out.orderBy(*order) if order else out
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def by_ids(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return df.join(ids.select(id).distinct(), id, "left_semi")


def first_or(df: DataFrame, keys: DataFrame, key: str, value: str, default) -> DataFrame:
    """key, value: for each of keys the value of its least row, or a default."""
    found = df.groupBy(key).agg(F.min(value).alias(value))
    return keys.select(key).distinct().join(found, key, "left").select(key, F.coalesce(value, F.lit(default)).alias(value))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return unset_to_null(spark.read.schema(schema_of(table)).parquet(path))


def write_table(df: DataFrame, path: str, partition: str | None = "org", mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """pos, lat, lon, city, state, country from (gzipped) tab-separated lines of 17 columns or more.

    pos orders rows by file and place in it, which decides ties. Unnamed rows and those at exactly (0, 0) are left out.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), f.alias("f")).where(F.size("f") >= 17)
    rows = rows.select("pos", S.lenient_number(F.col("f")[4]).alias("lat"), S.lenient_number(F.col("f")[5]).alias("lon"), F.col("f")[1].alias("city"), F.col("f")[10].alias("state"), F.col("f")[8].alias("country"))
    return rows.where((F.col("city") != "") & ((F.col("lat") != 0) | (F.col("lon") != 0)))


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """id, token, score of a unigram tokenizer file, and its end id (an added token </s> or <eos> overrides 1)."""
    schema = "model struct<vocab:array<array<string>>>, added_tokens array<struct<id:int,content:string>>"
    file = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = file.select(F.posexplode("model.vocab").alias("id", "v")).select("id", F.col("v")[0].alias("token"), F.col("v")[1].try_cast("double").alias("score"))
    end = file.select(F.explode("added_tokens").alias("a")).where(F.col("a.content").isin("</s>", "<eos>")).select("a.id").head()
    return rows.where("token IS NOT NULL AND score IS NOT NULL"), end[0] if end else 1


def with_content(rows: DataFrame, spark: SparkSession, folder: str, file: str = "file", pattern: str = "*") -> DataFrame:
    """rows with the bytes of their file in folder (null where it is missing), each in one piece; with_parts() takes files of any length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias(file), "content")
    return rows.join(files, file, "left")


def with_parts(rows: DataFrame, spark: SparkSession, folder: str, file: str = "file", pattern: str = "*", part: int = PART) -> DataFrame:
    """rows with the bytes of their file in folder, at most `part` at a time: at (where they begin), content; both null where it is missing.

    Only names and lengths are joined; then each part, whatever the length of its file, is read where its row lies, so no
    bytes move and a task holds one part. A folder that Arrow cannot open is read by Spark, where a whole file is a row at first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias(file)
    places = F.explode_outer(F.when(F.col("length").isNotNull(), F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("length") / part)).cast("long") - 1), lambda k: k * part)))
    if not heads._seen_by_arrow(folder):
        found = files.select(name, "content", places.alias("at")).select(file, "at", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(part)).alias("content"))
        return rows.join(found, file, "left")
    found = rows.join(files.select(name, F.col("path").alias("_path"), "length"), file, "left").select(*rows.columns, "_path", places.alias("at"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(files.agg(F.sum("length")).first()[0] or 0) // (part * TASK_PARTS)))
    found = found.repartition(tasks, file, "at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, at) in enumerate(zip(batch.column("_path").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                content = heads.read_bytes(path, part, at) if path is not None else None
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in rows_columns), one.column("at"), pa.array([content], pa.binary())], [*rows_columns, "at", "content"])

    rows_columns = rows.columns
    return found.mapInArrow(run, f"{schema}, at long, content binary")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).load(folder)


def parse_vectors(df: DataFrame, column: str, dimension: int | None = None) -> DataFrame:
    """df with its JSON vector column as array<float>, without empty, malformed and (if given) wrongly long ones."""
    out = df.withColumn(column, F.from_json(column, "array<float>"))
    out = out.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull()))
    return out if dimension is None else out.where(F.size(column) == dimension)


def compact(changes: DataFrame, id: str = "id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The latest row of each id of a change log, without those whose latest change deletes them."""
    last = F.row_number().over(W.partitionBy(id).orderBy(F.desc(version)))
    return changes.withColumn("_n", last).where((F.col("_n") == 1) & ~F.coalesce(deleted, F.lit(False))).drop("_n", deleted)


def parse_probe(df: DataFrame, column: str = "probe") -> DataFrame:
    """df with duration_ms (truncated), width, height, codec from a probe's JSON text; null where it has none."""
    p = F.from_json(column, PROBE)
    out = df.withColumn("_p", p)
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), 0)
    ms = (F.col("_p.format.duration").try_cast("decimal(18,6)") * 1000).cast("bigint")
    return out.withColumns({"duration_ms": ms, "width": video["width"], "height": video["height"], "codec": video["codec_name"]}).drop("_p")


def change_feed(spark: SparkSession, path: str, table: str | None = None, schema=None) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema or schema_of(table)).parquet(path)
