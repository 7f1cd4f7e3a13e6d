"""What the operators of this subpackage share: text columns, shared folders, sizes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import let_go, materialise, shared_folder

__all__ = ["BLANKS", "block_count", "give_back", "held_out", "in_parts", "let_go", "materialise", "partitions", "read_table", "scratch", "sieve", "text_of", "words_of"]

#: Runs of the six ASCII blanks; words are what stands between them.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32(doc_id as text) leaves this remainder; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of texts that a Python task looks at before it gives memory back.
ROWS = 500


def give_back() -> None:
    """Returns freed memory to the system; an idle Python worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of texts a few rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
            give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = 4 << 20, least: int = 48) -> int:
    """How many blocks of about block_bytes the texts fill, found by one scan."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(least, -(-total // block_bytes))


def sieve(df: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df that agree with none of keys in the columns, and the rest, which may: only the rest needs a join.

    A bitmap of the keys' hashes is broadcast: 32 bits for each key, 2**28 (32 MB) at most, beyond which ever more rows are
    in the rest. keys: materialised; nulls are values like others; the columns have the same types on both sides.
    """
    bits = 1 << min(28, max(20, (32 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    held = keys.groupBy(F.bitmap_bucket_number(place).alias("_sieve_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_sieve_bits"))
    marked = df.withColumn("_sieve_place", place).join(F.broadcast(held), F.bitmap_bucket_number("_sieve_place") == F.col("_sieve_bucket"), "left")
    at = "bitmap_bit_position(_sieve_place)"
    hit = F.expr(f"coalesce((shiftright(cast(conv(hex(substring(_sieve_bits, cast({at} div 8 AS int) + 1, 1)), 16, 10) AS int), cast({at} % 8 AS int)) & 1) = 1, false)")
    return marked.where(~hit).select(*df.columns), marked.where(hit).select(*df.columns)
