"""A job queue as a stream: claims with a lease, retries, and a dead letter after the last attempt.

Events of a job (enqueued, claimed, done, failed) come in by event time. Each job is a row of a merged table; once the greatest
time is far enough behind the end of a claim's lease, what isn't done by then goes back into the queue or, after the last
attempt, to the dead letters. A lease that has run out also counts where an event later than its end comes before that,
so the outcome doesn't depend on how events fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sinks.merged import MergedTable

#: Rows that the queue gives: every change of a job's state.
CHANGES = "job_id long, state string, attempt int, at timestamp, until long, seq int"
_JOBS = "job_id long, state string, attempt int, until long, seq int"


def step(job: tuple | None, kind: str, at: int, most: int, lease: int) -> tuple[tuple | None, list[tuple]]:
    """One event of a job: its state (state, attempt, end of the lease in ms) before, and after with the changes (state, attempt, time) that it makes.

    What doesn't fit the state (a claim of a claimed job, an end without a claim, a second enqueuing) changes nothing.
    """
    changes = []
    if job and job[0] == "claimed" and at >= job[2]:
        job = ("dead" if job[1] >= most else "queued", job[1], 0)
        changes.append((job[0], job[1], job[2] or None))
    if kind == "enqueued" and job is None:
        job = ("queued", 0, 0)
    elif kind == "claimed" and job and job[0] == "queued":
        job = ("claimed", job[1] + 1, at + lease)
    elif kind == "done" and job and job[0] == "claimed":
        job = ("done", job[1], 0)
    elif kind == "failed" and job and job[0] == "claimed":
        job = ("dead" if job[1] >= most else "queued", job[1], 0)
    else:
        return job, changes
    return job, [*changes, (job[0], job[1], at)]


#: Kinds of events, in the order in which those of one moment count.
KINDS = ("enqueued", "done", "failed", "claimed")


def _played(most: int, lease: int, mark: int):
    """Jobs (job_id, events, state, attempt, until, seq) to the changes that their events make, and those of leases that end by mark. An event is its time in ms times 4 plus its kind's place."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, events, state, attempt, until, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                job, seq = None if state is None else (state, attempt, until), seq or 0
                for event in events or ():
                    end = job[2] if job else None
                    job, changes = step(job, KINDS[event & 3], event >> 2, most, lease)
                    for to, n, at in changes:
                        seq += 1
                        out.append((key, to, n, (end if at is None else at) * 1000, job[2] if job and to == "claimed" else 0, seq))
                if job and job[0] == "claimed" and job[2] <= mark:
                    out.append((key, "dead" if job[1] >= most else "queued", job[1], job[2] * 1000, 0, seq + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*out, strict=True), _CHANGED, strict=True)], schema=_CHANGED)

    return play


_CHANGED = pa.schema([("job_id", pa.int64()), ("state", pa.string()), ("attempt", pa.int32()), ("at", pa.timestamp("us", "UTC")), ("until", pa.int64()), ("seq", pa.int32())])


def run_queue(events: DataFrame, path: str, most: int = 3, lease: str = "30 minutes", delay: str = "1 hour") -> None:
    """All events (job_id long, kind, at timestamp) that are there now, then ends; a later run goes on after it. path/changes holds every change of a state (job_id, state, attempt, at, until when a claim holds, seq), once.

    States are queued, claimed, done and dead; attempt counts the claims, most of them are allowed, seq numbers a job's changes. A lease
    ends at at + lease. Events more than delay behind the greatest time of earlier batches are left out, as are rows with nulls.

    path/jobs is a merged table of the last change of each job, with a row without a job_id for the greatest time. A micro-batch plays the events of all its jobs
    within tasks and merges what changed; its number goes with the merge, so one that comes again changes nothing.
    """
    long, back = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (lease, delay))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1

    def play(batch: DataFrame, number: int) -> None:
        table = MergedTable(batch.sparkSession, f"{path}/jobs", ["job_id"], ["seq"])
        if table.holds(number):
            return
        held = table.read(_JOBS)
        before = held.where("job_id is null").agg(F.max("until")).first()[0]
        known = batch.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS)).select("job_id", F.unix_millis("at").alias("ms"), order.alias("order"))
        latest = max((x for x in (before, known.agg(F.max("ms")).first()[0]) if x is not None), default=None)
        if latest is None:
            return
        if before is not None:
            known = known.where(F.col("ms") > before - back)
        own = known.groupBy("job_id").agg(F.array_sort(F.collect_list(F.col("ms") * 4 + F.col("order"))).alias("events"))
        met = own.join(held.where("job_id is not null"), "job_id", "full_outer").where(F.col("events").isNotNull() | ((F.col("state") == "claimed") & (F.col("until") <= latest - back)))
        played = met.select("job_id", "events", "state", "attempt", "until", "seq").mapInArrow(_played(most, long, latest - back), CHANGES)
        played.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        changed = batch.sparkSession.read.parquet(f"{path}/changes/batch={number}").select("job_id", "state", "attempt", "until", "seq")
        mark = batch.sparkSession.createDataFrame([(None, "", 0, latest, number + 1)], _JOBS)
        table.merge(changed.union(mark), number)

    events.writeStream.foreachBatch(play).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def job_states(changes: DataFrame) -> DataFrame:
    """(job_id, state, attempt, at) of each job after its last change; the dead letters are those whose state is dead."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("state", "attempt", "at"), "seq").alias("last"))
    return last.select("job_id", "last.*")
