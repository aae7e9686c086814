"""Registered queries over streams that arrive in batches, some rows late. Each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.sources.files import table
from foliospark.streaming import queue, windows
from foliospark.streaming.ingest import scratch

#: Batches that the events arrive in, in order of time; one event in LATE comes with the next batch.
BATCHES, LATE = 3, 7

_ARRIVED = f"""e AS (SELECT *, least({BATCHES - 1}, (event_id * {BATCHES}) // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % {LATE} = 0 THEN 1 ELSE 0 END) AS batch FROM events),
  high AS (SELECT b.batch, (SELECT max(ts) FROM e WHERE e.batch < b.batch) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT batch FROM e) b),
  arrived AS (SELECT e.*, mark FROM e JOIN high USING (batch)), closed AS (SELECT max(ts) - INTERVAL 1 DAY AS last FROM e)"""


def _streamed(spark, d, **window) -> str:
    """The folder with closed windows and late rows after all batches have come, one run of the streams for each."""
    folder = scratch(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    last = e.agg(F.max("event_id") + 1).first()[0]
    batch = F.least(F.lit(BATCHES - 1), F.floor(F.col("event_id") * BATCHES / last) + F.when(F.col("event_id") % LATE == 0, 1).otherwise(0))
    for n in range(BATCHES):
        e.where(batch == n).write.mode("append").parquet(f"{folder}/in")
        windows.windowed(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "at", folder, "1 day", ["event_type"], **window)
    return folder


@query(f"WITH {_ARRIVED} SELECT ts::DATE::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM arrived, closed WHERE (mark IS NULL OR ts::DATE + INTERVAL 1 DAY > mark) AND ts::DATE + INTERVAL 1 DAY <= last GROUP BY ALL")
def stream_windows(spark, d):
    """Events of each type and day, written once a day is over."""
    folder = _streamed(spark, d)
    return spark.read.parquet(f"{folder}/windows").select("start", "event_type", "n")


@query(f"""WITH {_ARRIVED}, w AS (SELECT *, unnest([0, 6, 12, 18]) AS back FROM arrived), s AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(back) AS start FROM w)
  SELECT start, event_type, count(*)::BIGINT AS n FROM s, closed WHERE (mark IS NULL OR start + INTERVAL 1 DAY > mark) AND start + INTERVAL 1 DAY <= last GROUP BY ALL""")
def stream_sliding(spark, d):
    """Events of each type in windows of a day that begin every six hours; a late row counts in those that are still open."""
    folder = _streamed(spark, d, slide="6 hours")
    return spark.read.parquet(f"{folder}/windows").select("start", "event_type", "n")


@query(f"""WITH {_ARRIVED}, o AS (SELECT * FROM arrived WHERE mark IS NULL OR ts > mark - INTERVAL 1 MICROSECOND), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM o),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM g), t AS (SELECT event_type, session, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*)::BIGINT AS n FROM s GROUP BY ALL)
  SELECT start, event_type, n FROM t, closed WHERE until <= last""")
def stream_sessions(spark, d):
    """Events of each type in sessions that half an hour without one ends."""
    folder = _streamed(spark, d, gap="30 minutes")
    return spark.read.parquet(f"{folder}/windows").select("start", "event_type", "n")


@query(f"WITH {_ARRIVED} SELECT event_id, batch::INT AS batch FROM arrived WHERE ts::DATE + INTERVAL 1 DAY <= mark")
def stream_late_rows(spark, d):
    """The events that came after their day was closed, with the batch that brought them."""
    folder = _streamed(spark, d)
    return spark.read.parquet(f"{folder}/late").select("event_id", "batch")


_SCRIPT = {  # minutes after which a job of each type is claimed, fails or is done
    "signup": [("enqueued", 0)], "purchase": [("enqueued", 0), ("claimed", 1), ("done", 5)], "view": [("enqueued", 0), ("claimed", 1)],
    "error": [("enqueued", 0), *[(k, m + i) for m in (1, 3, 5) for i, k in enumerate(("claimed", "failed"))]], "click": [("enqueued", 0), ("claimed", 1), ("claimed", 40), ("claimed", 80)],
}


@query("""WITH e AS (SELECT event_id, event_type, ts, CASE event_type WHEN 'purchase' THEN 5 WHEN 'view' THEN 1 WHEN 'error' THEN 6 WHEN 'click' THEN 80 ELSE 0 END AS last FROM events),
  mark AS (SELECT max(ts + to_minutes(last)) - INTERVAL 1 HOUR AS mark FROM e)
  SELECT event_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'dead' WHEN 'view' THEN CASE WHEN ts + INTERVAL 31 MINUTE <= mark THEN 'queued' ELSE 'claimed' END
    WHEN 'click' THEN CASE WHEN ts + INTERVAL 110 MINUTE <= mark THEN 'dead' ELSE 'claimed' END ELSE 'queued' END AS state, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 3 WHEN 'click' THEN 3 ELSE 0 END::INT AS attempt FROM e, mark""")
def queued_jobs(spark, d):
    """Every event as a job: done, failed again and again, claimed and forgotten once or three times, or never claimed; leases of half an hour, three attempts."""
    folder = scratch(spark)
    steps = F.coalesce(*[F.when(F.col("event_type") == t, F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("after")) for k, m in rows])) for t, rows in _SCRIPT.items()], F.array(F.struct(F.lit("enqueued").alias("kind"), F.lit(0).alias("after"))))
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.explode(steps).alias("s"))
    e.select("job_id", "s.kind", F.timestamp_micros(F.unix_micros("ts") + F.col("s.after").cast("long") * 60_000_000).alias("at")).write.parquet(f"{folder}/in")
    queue.run_queue(spark.readStream.schema("job_id long, kind string, at timestamp").parquet(f"{folder}/in"), folder)
    return queue.job_states(spark.read.parquet(f"{folder}/changes")).select("job_id", "state", "attempt")
