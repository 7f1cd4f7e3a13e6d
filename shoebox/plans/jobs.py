"""Job queries and streams over `events`: its type is the job type, the number in its props the attempts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs
from ..operators.rounds import shared_folder
from ..streaming import retries, streams
from .base import Plans, table

PLANS = Plans()
NOW = "2024-01-15 00:00:00"
_JOBS = """(SELECT event_id AS id, user_id AS photo, event_type AS job_type, ['pending', 'processing', 'done', 'failed'][(event_id % 4 + 1)::INT] AS status,
    (event_id * 7 % 4) AS attempts, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 DAY END AS scheduled_at, ts AS created_at FROM events)"""


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("photo"), F.col("event_type").alias("job_type"), status.alias("status"), (F.col("event_id") * 7 % 4).alias("attempts"), F.lit("").alias("last_error"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("scheduled_at"), F.col("ts").alias("created_at"))


@PLANS.add(f"SELECT s.status, count(j.id) AS n FROM (SELECT unnest(['pending', 'processing', 'done', 'failed']) AS status) s LEFT JOIN {_JOBS} j ON j.status = s.status AND j.attempts < 9 GROUP BY 1")
def job_status(spark, sf_dir):
    return jobs.status_counts(_jobs(spark, sf_dir))


@PLANS.add(f"""
    SELECT id, job_type FROM {_JOBS} WHERE status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{NOW}')""")
def job_due(spark, sf_dir):
    return _jobs(spark, sf_dir).where(jobs.is_due(NOW)).select("id", "job_type")


@PLANS.add(f"""
    SELECT job_type, count(*) AS n FROM (SELECT * FROM {_JOBS} WHERE status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{NOW}') ORDER BY created_at, id LIMIT 64) GROUP BY 1""")
def job_due_batch(spark, sf_dir):
    return jobs.by_type(jobs.due_batch(_jobs(spark, sf_dir), NOW, 64)).select("job_type", "n")


@PLANS.add(f"""
    SELECT id, CASE WHEN status <> 'processing' THEN status WHEN id % 3 = 0 THEN 'done' WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS status,
        CASE WHEN status = 'processing' AND id % 3 <> 0 THEN attempts + 1 ELSE attempts END AS attempts,
        CASE WHEN status = 'processing' AND id % 3 <> 0 AND attempts + 1 < 3 THEN TIMESTAMP '{NOW}' + to_seconds(30 * (1 << (attempts + 1)::INT)) ELSE scheduled_at END AS scheduled_at FROM {_JOBS}""")
def job_next_state(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    outcomes = j.where("status = 'processing'").select("id", F.when(F.col("id") % 3 != 0, "broken").alias("error"))
    return jobs.apply_outcomes(j, outcomes, NOW).select("id", "status", "attempts", "scheduled_at")


@PLANS.add(f"""
    SELECT id, CASE WHEN status = 'processing' OR (status = 'failed' AND attempts < 3) THEN 'pending' ELSE status END AS status,
        CASE WHEN status = 'failed' AND attempts < 3 THEN TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE ELSE scheduled_at END AS scheduled_at FROM {_JOBS}""")
def job_reconcile(spark, sf_dir):
    return jobs.reconcile(_jobs(spark, sf_dir), NOW).select("id", "status", "scheduled_at")


@PLANS.add(f"SELECT id FROM {_JOBS} WHERE status <> 'done' OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def job_retention(spark, sf_dir):
    return jobs.retained(_jobs(spark, sf_dir), NOW).select("id")


def _media(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("pending", "failed", "done"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("ml_status"), F.when(F.col("o_custkey") % 2 == 0, 0.0).otherwise(F.col("o_totalprice") / 1e6).alias("latitude"), F.lit(0.0).alias("longitude"))


@PLANS.add("SELECT o_orderkey AS photo, unnest(['run_ocr', 'compute_phash']) AS job_type FROM orders WHERE o_orderkey % 3 < 2")
def reprocess_fanout(spark, sf_dir):
    return jobs.reprocess(_media(spark, sf_dir), ["run_ocr", "no_such_job", "compute_phash"], "pending")


@PLANS.add("SELECT count(*) AS enqueued, count(DISTINCT o_orderkey) AS photos FROM orders, (SELECT unnest([1, 2])) WHERE o_orderkey % 3 = 1")
def reprocess_totals(spark, sf_dir):
    return jobs.reprocess_totals(jobs.reprocess(_media(spark, sf_dir), ["run_ocr", "detect_faces"], "failed"))


@PLANS.add("""
    SELECT o_orderkey AS photo, job_type FROM (SELECT o_orderkey, unnest(['compute_phash', 'detect_faces', 'encode_clip', 'run_ocr', CASE WHEN o_custkey % 2 <> 0 AND o_totalprice <> 0 THEN 'reverse_geocode' END]) AS job_type FROM orders) WHERE job_type IS NOT NULL""")
def initial_jobs(spark, sf_dir):
    return jobs.initial_jobs(_media(spark, sf_dir))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _finished(spark, query, path, schema):
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


@PLANS.add("""
    SELECT event_id AS photo, job_type FROM (SELECT event_id, unnest(['compute_phash', 'detect_faces', 'encode_clip', 'run_ocr', CASE WHEN value <> 0 THEN 'reverse_geocode' END]) AS job_type FROM events) WHERE job_type IS NOT NULL""")
def ingest_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(".jpg")).alias("file"), F.lit("").alias("mime_type"), F.lit("").alias("type"), F.lit("").alias("ml_status"), F.col("ts").alias("taken_at"), F.col("value").alias("latitude"), F.lit(0.0).alias("longitude"))
    out = streams.ingest_jobs(rows, NOW).select("photo", "job_type")
    path = _folder(spark, "ingest")
    return _finished(spark, streams.run_once(out, path, f"{path}-state"), path, out.schema)


@PLANS.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def live_counts(spark, sf_dir):
    counts = streams.live_counts(_stream(spark, sf_dir), "event_type")
    path = _folder(spark, "counts")
    query = streams.each_batch(counts, lambda batch, _: batch.write.mode("overwrite").parquet(path), f"{path}-state", "complete")
    return _finished(spark, query, path, counts.schema)


@PLANS.add("""
    SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    WHERE b IS NULL OR b <> event_type""")
def changed_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    out = streams.changed_values(_stream(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    path = _folder(spark, "changed")
    return _finished(spark, streams.run_once(out, path, f"{path}-state"), path, out.schema).select("event_id", "event_type")


@PLANS.add("""
    WITH o AS (SELECT user_id AS job, event_id AS outcome, ts AS "at", event_type <> 'signup' AS failed, row_number() OVER w AS k, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT o.* FROM o LEFT JOIN (SELECT job, min(k) AS first FROM o WHERE NOT failed GROUP BY job) d ON d.job = o.job WHERE o.k <= 3 AND (d.first IS NULL OR o.k <= d.first))
    SELECT job, outcome, (k - 1)::INT AS attempts, 'done' AS status, "at" FROM p WHERE NOT failed
    UNION ALL SELECT job, outcome, 3, 'failed', "at" FROM p WHERE failed AND k = 3
    UNION ALL SELECT job, outcome, k::INT, 'again', "at" + to_seconds(30 * (1 << k::INT)) FROM p WHERE failed AND k < 3
        AND ("at" + to_seconds(30 * (1 << k::INT)) <= next OR next IS NULL AND "at" + to_seconds(30 * (1 << k::INT)) < (SELECT max(ts) FROM events))""")
def retry_stream(spark, sf_dir):
    """Events as outcomes of their users' jobs, in four micro-batches by time; timers bring the failed ones back."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("outcome"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "signup").alias("failed"))
    path = _folder(spark, "retries")
    for part in range(4):
        e.where(F.least(F.floor((F.dayofmonth("at") - 1) / 8), F.lit(3)) == part).write.mode("append").parquet(f"{path}-in")
        out = retries.retries(spark.readStream.schema(e.schema).parquet(f"{path}-in"))
        streams.run_once(out, path, f"{path}-state").awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
