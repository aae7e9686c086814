"""Registered queries along time: status histories, as-of and interval joins, pages of changes. Each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import timeline
from foliospark.plans.registry import query
from foliospark.sources.files import table
from foliospark.sources.incremental import pull_all
from foliospark.streaming.ingest import scratch

_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'uploaded' ELSE 'processing' END"


def _events(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "signup", "uploaded").otherwise("processing")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")


_STEPS = " OR ".join(f"(coalesce(was, '') = '{a or ''}' AND status IN ({', '.join(repr(b) for b in following)}))" for a, following in timeline.LEGAL.items() if following)
_HISTORY = f"""e AS (SELECT user_id AS document_id, {_STATUS} AS status, ts AS moment, event_id FROM events),
  k AS (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY moment, event_id) AS was FROM e),
  history AS (SELECT document_id, was, status, moment AS valid_from, lead(moment) OVER (PARTITION BY document_id ORDER BY moment, event_id) AS valid_to, {_STEPS} AS legal, event_id FROM k WHERE was IS DISTINCT FROM status)"""


@query(f"WITH {_HISTORY} SELECT document_id, was, status, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, legal, event_id FROM history")
def status_intervals(spark, d):
    """Every status with the time from and to which it held, and whether the step to it is allowed."""
    h = timeline.status_history(_events(spark, d))
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?)0+$", "$1").alias(c)
    return h.select("document_id", "was", "status", text("valid_from"), text("valid_to"), "legal", "event_id")


@query(f"WITH {_HISTORY} SELECT document_id, was, status, count(*)::BIGINT AS n FROM history WHERE NOT legal GROUP BY ALL")
def illegal_steps(spark, d):
    found = timeline.illegal_steps(timeline.status_history(_events(spark, d)))
    return found.groupBy("document_id", "was", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_HISTORY} SELECT document_id, status, round(sum(greatest(0, epoch_us(coalesce(valid_to, TIMESTAMP '2030-01-01')) - epoch_us(valid_from)) / 1e6), 3) AS seconds FROM history GROUP BY ALL")
def time_in_status(spark, d):
    return timeline.time_in_status(timeline.status_history(_events(spark, d)), F.lit("2030-01-01")).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH e AS (SELECT user_id AS document_id, {_STATUS} AS status, ts AS moment, event_id FROM events)
  SELECT document_id, arg_max(status, (moment, event_id)) AS status, min(moment) FILTER (status = 'processing') AS started_at, max(moment) FILTER (status IN ('completed', 'failed')) AS completed_at FROM e GROUP BY document_id""")
def status_times(spark, d):
    """The first start, the last end and the last status of each document."""
    return timeline.status_times(_events(spark, d))


@query(f"""WITH {_HISTORY}, asked AS (SELECT event_id AS ask, user_id AS document_id, ts + INTERVAL 90 MINUTE AS moment FROM events)
  SELECT ask, arg_max(h.status, (h.valid_from, h.event_id)) AS status FROM asked a LEFT JOIN history h ON h.document_id = a.document_id AND h.valid_from <= a.moment GROUP BY ask""")
def status_as_of(spark, d):
    """The status that each document had 90 minutes after each of its events."""
    asked = table(spark, d, "events").select(F.col("event_id").alias("ask"), F.col("user_id").alias("document_id"), (F.col("ts").cast("timestamp") + F.expr("interval 90 minutes")).alias("at"))
    return timeline.as_of(asked, timeline.status_history(_events(spark, d)), "document_id", "at", "valid_from", "event_id", ["status"]).select("ask", "status")


@query("""SELECT p.event_id AS event, s.event_id AS session FROM (SELECT * FROM events WHERE event_type = 'error') p
  LEFT JOIN (SELECT *, ts + INTERVAL (value) MINUTE * CASE WHEN event_id % 50 = 0 THEN 3000 ELSE 10 END AS until FROM events WHERE event_type <> 'error') s ON p.user_id = s.user_id AND s.ts <= p.ts AND p.ts < s.until""".replace("INTERVAL (value) MINUTE * CASE WHEN event_id % 50 = 0 THEN 3000 ELSE 10 END", "to_seconds((floor(value) * 60 * CASE WHEN event_id % 50 = 0 THEN 3000 ELSE 10 END)::BIGINT)"))
def errors_in_sessions(spark, d):
    """Errors with every session of their user that was open then: sessions of minutes to months, those that overlap all count."""
    e = table(spark, d, "events")
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("at"))
    seconds = F.floor("value") * 60 * F.when(F.col("event_id") % 50 == 0, 3000).otherwise(10)
    open_ = e.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("session"), F.col("ts").cast("timestamp").alias("since"))
    open_ = open_.join(e.select(F.col("event_id").alias("session"), seconds.alias("s")), "session").withColumn("until", F.timestamp_micros(F.unix_micros("since") + F.col("s") * 1_000_000)).drop("s")
    return timeline.interval_join(points, open_, "user_id", "at", "since", "until", how="left").select("event", "session")



@query("SELECT o_orderkey AS document_id, ((row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) - 1) // (SELECT count(*) // 5 + 1 FROM orders))::INT AS page FROM orders")
def pulled_pages(spark, d):
    """All orders in five pages by (time, id), where the time is the year: thousands share one, none is lost or comes twice."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.make_timestamp(F.year("o_orderdate"), *[F.lit(n) for n in (1, 1, 0, 0, 0)]).alias("updated_at"))
    return pull_all(spark, rows, scratch(spark), rows.count() // 5 + 1, overlap="1 day").select("document_id", "page")
