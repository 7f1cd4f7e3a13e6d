"""The first bytes of files: a Python data source over folders, and a reader for the files that rows name.

    spark.dataSource.register(heads.FileHeads)
    spark.read.format("file_heads").option("bytes", 65536).load(folder)     # path, length, head

A task opens its files at their first byte and reads no further than asked, so metadata of a library costs the same for
large files as for small ones. Files are opened through Arrow's file systems; with_heads() reads whole files through Spark
where a store is known to Spark only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .exif import EXAMINED

#: Bytes that camera metadata stands in, and files of a task.
BYTES, FILES = 2 + EXAMINED, 512
_NAMES = ["path", "length", "head"]


def open_store(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if ":" not in path.split("/")[0]:
        return pfs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return pfs.FileSystem.from_uri(f"file://{rest if rest.startswith('/') and not rest.startswith('//') else rest[2:]}" if scheme == "file" else path)


def read_bytes(path: str, n: int, start: int = 0) -> bytes | None:
    """At most n bytes of a file from start on; None where there is no such file."""
    store, at = open_store(path)
    try:
        with store.open_input_file(at) as f:
            return f.read_at(max(0, min(n, f.size() - start)), start)
    except FileNotFoundError:
        return None


class Paths(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class HeadsReader(DataSourceReader):
    def __init__(self, folder: str, n: int, each: int):
        self.folder, self.n, self.each = folder, n, each

    def partitions(self) -> list[InputPartition]:
        """The folder's files, below any of its folders, in the order of their paths; hidden ones are left out."""
        store, at = open_store(self.folder)
        found = store.get_file_info(pfs.FileSelector(at, recursive=True))
        shown = lambda p: not any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/"))
        head = self.folder.rstrip("/")
        files = sorted((head + f.path[len(at.rstrip("/")) :], f.size) for f in found if f.type == pfs.FileType.File and shown(f.path))
        return [Paths(files[k : k + self.each]) for k in range(0, len(files), self.each)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(partition.files), 64):
            part = partition.files[k : k + 64]
            heads = [read_bytes(p, self.n) for p, _ in part]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64()), pa.array(heads, pa.binary())], _NAMES)


class FileHeads(DataSource):
    """Options: path, bytes (BYTES), files: how many a task reads (FILES)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options["path"], int(self.options.get("bytes", BYTES)), int(self.options.get("files", FILES)))


def read_heads(spark: SparkSession, folder: str, n: int = BYTES, files: int = FILES) -> DataFrame:
    """path, length, head of every file below folder."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", n).option("files", files).load(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of every file below folder, hidden ones left out. The driver lists the folder itself; tasks list the folders in
    it, so that no library's names are gathered."""
    store, at = open_store(folder)
    head = folder.rstrip("/")
    named = lambda p: head + p[len(at.rstrip("/")) :]
    shown = lambda f: f.base_name[:1] not in ("", ".", "_")
    top = [(x, True) for x in _inner(store, at)] + [(at, False)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            while todo:
                path, deep = todo.pop()
                found = [f for f in store.get_file_info(pfs.FileSelector(path)) if shown(f)]
                todo += [(f.path, True) for f in found if deep and f.type == pfs.FileType.Directory]
                files = [f for f in found if f.type == pfs.FileType.File]
                for k in range(0, len(files), 4096):
                    part = files[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([named(f.path) for f in part], pa.string()), pa.array([f.size for f in part], pa.int64())], _NAMES[:2])

    return spark.createDataFrame(top, "folder string, deep boolean").repartition(max(1, len(top))).mapInArrow(walk, "path string, length long")


def _inner(store: pfs.FileSystem, at: str) -> list[str]:
    return [f.path for f in store.get_file_info(pfs.FileSelector(at)) if f.type == pfs.FileType.Directory and f.base_name[:1] not in ("", ".", "_")]


def _seen_by_arrow(folder: str) -> bool:
    try:
        store, at = open_store(folder)
        return store.get_file_info(at).type != pfs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def listed_heads(spark: SparkSession, folder: str, n: int = BYTES) -> DataFrame:
    """path, length, head of every file below folder, as read_heads() gives them; files are listed in tasks and dealt out anew."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([read_bytes(p, n) for p in part.column(0).to_pylist()], pa.binary())], _NAMES)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return list_files(spark, folder).repartition(parts, "path").mapInArrow(read, "path string, length long, head binary")


def with_heads(rows: DataFrame, spark: SparkSession, folder: str, file: str = "file", n: int = BYTES) -> DataFrame:
    """rows with the first n bytes (head) of their file, named by its path below folder; null where it is missing or not named.

    No bytes of files move: each row's file is opened by the task that holds the row.
    """
    root = folder.rstrip("/")
    if not _seen_by_arrow(folder):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        top = F.expr("regexp_replace(path, '^[a-z0-9+.-]+:/*', '/')")
        name = F.substring_index(top, root.split(":", 1)[-1].lstrip("/") + "/", -1)
        return rows.join(found.select(name.alias(file), F.substring("content", 1, n).alias("head")), file, "left")
    at = rows.columns.index(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                heads = [read_bytes(f"{root}/{x}", n) if x else None for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], [*part.schema.names, "head"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, head binary")


def write_files(rows: DataFrame, folder: str, file: str = "file", content: str = "content") -> int:
    """Writes each row's content to its path below folder, in tasks; returns how many. Files that are there are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        n, made = 0, set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{name}"
                if (own := path.rsplit("/", 1)[0]) not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(path) as f:
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.where(F.col(file).isNotNull() & F.col(content).isNotNull()).select(file, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
