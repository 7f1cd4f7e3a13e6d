"""Enrichment jobs as a table: fan-out, due batches, outcomes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Job types and states.
JOB_TYPES = ("compute_phash", "detect_faces", "encode_clip", "run_ocr", "reverse_geocode", "recognize_faces")
STATUSES = ("pending", "processing", "done", "failed")
MAX_ATTEMPTS = 3
RETENTION_DAYS = 7


def initial_jobs(media: DataFrame, ocr: bool = True, id: str = "id") -> DataFrame:
    """photo, job_type: three jobs for every photo, text recognition if enabled, geocoding if it has a position."""
    located = S.has_position(F.col("latitude"), F.col("longitude"))
    kinds = F.array_compact(F.array(F.lit("compute_phash"), F.lit("detect_faces"), F.lit("encode_clip"), F.when(F.lit(ocr), "run_ocr"), F.when(located, "reverse_geocode")))
    return media.select(F.col(id).alias("photo"), F.explode(kinds).alias("job_type"))


def select_status(status: str = "all", column: str = "ml_status") -> Column:
    if status == "all":
        return F.lit(True)
    return F.col(column).isin("pending", "failed") if status == "pending" else F.col(column) == status


def reprocess(media: DataFrame, job_types: list[str], status: str = "all", id: str = "id") -> DataFrame:
    """photo, job_type of every selected photo and known job type; unknown names are ignored."""
    kinds = [k for k in dict.fromkeys(job_types) if k in JOB_TYPES]
    return media.where(select_status(status)).select(F.col(id).alias("photo"), F.explode(F.array(*map(F.lit, kinds)) if kinds else F.expr("cast(array() AS array<string>)")).alias("job_type"))


def reprocess_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("enqueued"), F.count_distinct("photo").alias("photos"))


def is_due(now: str | Column) -> Column:
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return (F.col("status") == "pending") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now))


def due_batch(jobs: DataFrame, now: str, size: int) -> DataFrame:
    """The oldest due jobs, at most `size` (the worker's batch)."""
    return jobs.where(is_due(now)).orderBy("created_at", "id").limit(size)


def by_type(batch: DataFrame) -> DataFrame:
    return batch.groupBy("job_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("photo")).alias("photos"))


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """jobs after outcomes (id, error: null if it went well): done; pending again after a delay; failed at MAX_ATTEMPTS."""
    got = outcomes.select("id", F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    tries = F.col("attempts") + 1
    bad = F.col("_ran") & F.col("_error").isNotNull()
    at = F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + S.retry_delay_seconds(tries))
    again = bad & (tries < MAX_ATTEMPTS)
    out = jobs.join(got, "id", "left").withColumns({
        "status": F.when(F.col("_ran").isNull(), F.col("status")).when(again, "pending").when(bad, "failed").otherwise("done"),
        "scheduled_at": F.when(again, at).otherwise(F.col("scheduled_at")),
        "last_error": F.when(bad, F.col("_error")).otherwise(F.col("last_error")),
        "attempts": F.when(bad, tries).otherwise(F.col("attempts")),
    })
    return out.select(*jobs.columns)


def reconcile(jobs: DataFrame, now: str) -> DataFrame:
    """jobs after a restart: interrupted ones are pending, failed ones with attempts left are pending a minute from now."""
    retry = (F.col("status") == "failed") & (F.col("attempts") < MAX_ATTEMPTS)
    at = F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + 60)
    return jobs.withColumns({"scheduled_at": F.when(retry, at).otherwise(F.col("scheduled_at")), "status": F.when(retry | (F.col("status") == "processing"), "pending").otherwise(F.col("status"))})


def status_counts(jobs: DataFrame) -> DataFrame:
    """status, n for each of STATUSES, zero-filled."""
    names = jobs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    n = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def retained(jobs: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """jobs without those done that were created more than `days` ago."""
    return jobs.where((F.col("status") != "done") | (F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))
