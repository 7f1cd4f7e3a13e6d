"""Retries as a stream: a failed job sets a timer for its delay and comes out again when the timer fires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import MAX_ATTEMPTS

#: Keys of the state: each holds its share of the jobs, packed, so that a call handles many jobs.
BUCKETS = 1024
_JOB = np.dtype([("job", "<i8"), ("attempts", "<i4"), ("outcome", "<i8"), ("due", "<i8"), ("settled", "?")])
_STATE, _NEVER = "jobs binary", int(np.iinfo(np.int64).min)
_OUT = "job long, outcome long, attempts int, status string, micros long"
_COLUMNS = ["job", "outcome", "attempts", "status", "micros"]


def delay_seconds(attempts: int) -> int:
    """30 seconds, doubled for each attempt."""
    return 30 << attempts


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What becomes of the new outcomes of a bucket's jobs, and of its timers. The bucket's own timer is that of its next job.

    Outcomes come by time. A failure with attempts left sets the job's timer; one that uses up the attempts makes the job
    failed, a success makes it done, and both end it. An outcome that comes before the timer has fired replaces it; one that
    comes later finds that the retry is out.
    """
    jobs = {x[0]: x[1:] for x in np.frombuffer(state.get[0], _JOB).tolist()} if state.exists else {}
    parts = [] if state.hasTimedOut else [[f[c].to_numpy() for c in ("job", "micros", "outcome", "failed")] for f in frames]
    out = []
    if parts:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((columns[2], columns[1]))
        for job, now, number, failed in zip(*(c[order].tolist() for c in columns), strict=True):
            attempts, outcome, due, settled = jobs.get(job, (0, 0, _NEVER, False))
            if settled:
                continue
            if _NEVER < due <= now:
                out.append((job, outcome, attempts, "again", due))
            attempts += failed
            settled = not failed or attempts >= MAX_ATTEMPTS
            if settled:
                out.append((job, number, attempts, "failed" if failed else "done", now))
            jobs[job] = attempts, number, _NEVER if settled else now + delay_seconds(attempts) * 1_000_000, settled
    held = np.array([(job, *x) for job, x in jobs.items()], _JOB)
    waiting = held["due"] > _NEVER
    fired = waiting & (held["due"] // 1000 < state.getCurrentWatermarkMs())  # the stream's time has milliseconds
    out += [(job, outcome, attempts, "again", due) for job, attempts, outcome, due, _ in held[fired].tolist()]
    held["due"][fired] = _NEVER
    state.update((held.tobytes(),))
    if (waiting & ~fired).any():
        state.setTimeoutTimestamp(int(held["due"][waiting & ~fired].min()) // 1000)
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


def retries(outcomes: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """job, outcome, attempts, status, at: what becomes of a stream of outcomes (job, outcome: its number, at, failed).

    status is done, failed (after MAX_ATTEMPTS), or again: the job is to run again at `at`, which comes out once the stream's
    time (the latest `at` less `late`) has passed it. Jobs are dealt to buckets by their hash; a stream keeps its number of
    buckets for life. Outcomes of no job or no time are ignored.
    """
    rows = outcomes.select(F.col("job").cast("long").alias("job"), F.col("outcome").cast("long").alias("outcome"), "at", F.unix_micros("at").alias("micros"), F.coalesce("failed", F.lit(False)).alias("failed"))
    rows = rows.where("job IS NOT NULL AND at IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets)))
    found = rows.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(_changes, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("job", "outcome", "attempts", "status", F.timestamp_micros("micros").alias("at"))
