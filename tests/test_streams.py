"""Queues and windows of streams in several runs, against events played one by one."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliospark.streaming import queue, windows

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_steps_of_a_job():
    lease = 30
    job, changes = None, []
    for kind, moment in [("claimed", 1), ("enqueued", 2), ("enqueued", 3), ("done", 4), ("claimed", 5), ("claimed", 6), ("failed", 7), ("claimed", 10), ("done", 41), ("claimed", 50), ("failed", 60), ("claimed", 61)]:
        job, more = queue.step(job, kind, moment, 3, lease)
        changes += more
    assert [(s, n) for s, n, _ in changes] == [("queued", 0), ("claimed", 1), ("queued", 1), ("claimed", 2), ("queued", 2), ("claimed", 3), ("dead", 3)]


def test_queue_in_several_runs_is_the_queue_played_at_once(spark, tmp_path):
    draw, rows = random.Random(4), []
    for job in range(30):
        moment = draw.randrange(600)
        for kind in ["enqueued", *[draw.choice(["claimed", "claimed", "done", "failed"]) for _ in range(draw.randrange(7))]]:
            rows.append((job, kind, moment))
            moment += draw.choice([1, 5, 29, 30, 31, 90])
    rows += [(None, "enqueued", 3), (5, "odd", 3), (99, "enqueued", 5000)]  # the last one moves the watermark past all leases
    schema = "job_id long, kind string, at timestamp"
    for part in range(4):  # in order of time, a run for each
        own = [(j, k, at(m)) for j, k, m in rows if min(3, m // 200) == part]
        spark.createDataFrame(own, schema).write.mode("append").parquet(f"{tmp_path}/in")
        queue.run_queue(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), str(tmp_path))
    want = {}
    for job in {j for j, _, _ in rows if j is not None}:
        state = None
        events = sorted((m, queue.KINDS.index(k), k) for j, k, m in rows if j == job and k in queue.KINDS)
        for moment, _, kind in [*events, (4000, 0, "expired")] if job != 99 else events:
            state, _ = queue.step(state, kind, moment, 3, 30)
        want[job] = state[:2]
    changes = spark.read.parquet(f"{tmp_path}/changes")
    got = {r["job_id"]: (r["state"], r["attempt"]) for r in queue.job_states(changes).collect()}
    assert got == want and {"done", "dead", "queued"} <= {s for s, _ in got.values()}
    assert changes.groupBy("job_id", "seq").count().where("count > 1").count() == 0


def test_late_rows_are_kept_apart_and_windows_written_once(spark, tmp_path):
    schema = "at timestamp, k string"
    batches = [[10, 50, 70], [65, 5, 300, None], [290, 100, 400]]  # of an hour with a delay of half an hour: 5 and 100 come too late
    for part in batches:
        spark.createDataFrame([(None if m is None else at(m), "a") for m in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            windows.windowed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", str(tmp_path), "30 minutes", ["k"], width="1 hour")
    late = {r["at"] for r in spark.read.parquet(f"{tmp_path}/late").collect()}
    assert late == {at(100), None} and spark.read.parquet(f"{tmp_path}/on_time").count() == 8
    closed = {r["start"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    assert closed == {at(0): 3, at(60): 2, at(240): 1, at(300): 1}
    assert spark.read.parquet(f"{tmp_path}/windows").agg(F.sum("n")).first()[0] == 7


def test_queue_plays_all_jobs_of_a_batch_together(spark, tmp_path):
    """A Python call for each job took milliseconds: twenty thousand jobs were minutes. A batch that comes again changes nothing."""
    import shutil
    import time

    n, schema = 20_000, "job_id long, kind string, at timestamp"
    made = spark.range(n).selectExpr("id as job_id", "explode(array(struct('enqueued' as kind, 0 as m), struct('claimed' as kind, 1 as m), struct('done' as kind, 5 as m))) as e").selectExpr("job_id", "e.kind", f"timestamp'{T0}' + make_interval(0, 0, 0, 0, 0, e.m) as at")
    made.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    began = time.perf_counter()
    queue.run_queue(stream, str(tmp_path))
    took = time.perf_counter() - began
    shutil.rmtree(f"{tmp_path}/state/commits")  # as if the run had been lost at its very end
    queue.run_queue(stream, str(tmp_path))
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert changes.count() == 3 * n and queue.job_states(changes).where("state = 'done' and attempt = 1").count() == n and took < 60
