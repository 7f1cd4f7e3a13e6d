"""Retries by timers against a plain walk over the outcomes."""

import datetime
import random

from pyspark.sql import functions as F

from shoebox.streaming import retries, streams

START = datetime.datetime(2024, 1, 1)


def walk(rows):
    """(job, outcome, attempts, status, at) of every change; retries only if the stream's time passes them."""
    last, out, jobs = max(r[2] for r in rows), [], {}
    for job, outcome, at, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        attempts, due, of, settled = jobs.get(job, (0, None, None, False))
        if settled:
            continue
        if due is not None and due <= at:
            out.append((job, of, attempts, "again", due))
        if not failed:
            out.append((job, outcome, attempts, "done", at))
            jobs[job] = (attempts, None, outcome, True)
        elif attempts + 1 >= 3:
            out.append((job, outcome, attempts + 1, "failed", at))
            jobs[job] = (attempts + 1, None, outcome, True)
        else:
            jobs[job] = (attempts + 1, at + datetime.timedelta(seconds=30 << (attempts + 1)), outcome, False)
    for job, (attempts, due, of, settled) in jobs.items():
        if due is not None and not settled and due < last - datetime.timedelta(seconds=1):
            out.append((job, of, attempts, "again", due))
    return sorted(out)


def test_timers_fire_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    r = random.Random(2)
    rows = []
    for k in range(300):
        rows.append((r.randrange(40), k, START + datetime.timedelta(seconds=20 * k + r.random()), r.random() < 0.8))
    rows.append((999, 300, START + datetime.timedelta(hours=5), False))
    for n in range(4):
        spark.createDataFrame(rows[n * 76 : n * 76 + 76], "job long, outcome long, at timestamp, failed boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, outcome long, at timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = streams.run_once(retries.retries(stream), out, str(tmp_path / "state"))
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) >= 4
    got = sorted((x.job, x.outcome, x.attempts, x.status, x.at) for x in spark.read.parquet(out).select("*", F.lit(1)).collect())
    assert got == walk(rows)


def test_a_call_handles_many_jobs(monkeypatch):
    """Jobs share keys of the state: what a call costs does not grow with their number."""
    import numpy as np
    import pandas as pd

    class Held:
        exists, hasTimedOut, timeout = False, False, None

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def getCurrentWatermarkMs(self):
            return self.watermark

    held = Held()
    held.watermark = 0
    frame = pd.DataFrame({"job": np.arange(500), "micros": np.arange(500) * 1000, "outcome": np.arange(500), "failed": np.arange(500) % 2 == 0})
    out = pd.concat(retries._changes((0,), iter([frame[250:], frame[:250]]), held))
    assert len(out) == 250 and set(out["status"]) == {"done"} and held.timeout == 60_000
    held.hasTimedOut, held.watermark = True, 60_100
    out = pd.concat(retries._changes((0,), iter([]), held))
    assert out["job"].tolist() == list(range(0, 100, 2)) and set(out["status"]) == {"again"} and held.timeout == 60_100
