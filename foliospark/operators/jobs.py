"""Jobs, batches and status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, of: Column, empty: float = 0.0) -> Column:
    return F.when(of > 0, part / of * 100).otherwise(empty)


def batch_totals(outcomes: DataFrame, planned: Column | None = None) -> DataFrame:
    """(batch_id, document_id, success) to totals, failures, progress and success rate of each batch."""
    sums = outcomes.groupBy("batch_id").agg(F.count("*").alias("processed"), F.count_if(~F.col("success")).alias("failed"))
    total = F.col("processed") if planned is None else planned
    done = F.col("processed")
    return sums.select("batch_id", total.alias("total"), "processed", "failed", percent(done, total).alias("progress"), percent(done - F.col("failed"), done).alias("success_rate"))


def remaining_seconds(elapsed: Column, processed: Column, total: Column) -> Column:
    """Time that the rest takes at the pace so far; 0 before the first result."""
    return F.when(processed > 0, elapsed / processed * (total - processed)).otherwise(0.0)


def running_progress(outcomes: DataFrame) -> DataFrame:
    """Results of each batch in order of completion with the number processed and failed so far.

    Order within hours and what earlier hours hand on replace one sort of a batch, so a batch that holds most rows is no single task.
    """
    rows = outcomes.select("batch_id", "document_id", "completed_at", F.when(F.col("success"), 0).otherwise(1).alias("bad"), F.date_trunc("hour", F.col("completed_at").cast("timestamp")).alias("hour"))
    hours = rows.groupBy("batch_id", "hour").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    earlier = Window.partitionBy("batch_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("batch_id", "hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.coalesce(F.sum("bad").over(earlier), F.lit(0)).alias("ahead_bad"))
    so_far = Window.partitionBy("batch_id", "hour").orderBy("completed_at", "document_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("batch_id", "document_id", "hour", F.count("*").over(so_far).alias("n"), F.sum("bad").over(so_far).alias("bad"))
    # an hour that is null is one of its own
    met = own.join(hours.withColumnsRenamed({"batch_id": "b", "hour": "h"}), F.col("batch_id").eqNullSafe(F.col("b")) & F.col("hour").eqNullSafe(F.col("h")))
    return met.select("batch_id", "document_id", (F.col("n") + F.col("ahead")).alias("processed"), (F.col("bad") + F.col("ahead_bad")).alias("failed"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; keep columns in order total, so that ties can't decide.

    max_by combines before the shuffle, so a key with many rows costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, "__last.*")


def status_tally(documents: DataFrame, codes: dict[str, str]) -> DataFrame:
    """One row: all documents, and those of each status, case ignored; codes: {column: status}."""
    return documents.agg(F.count("*").alias("total"), *[F.count_if(F.lower("status") == s).alias(name) for name, s in codes.items()])


def tail(history: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, in their order; 0 gives none."""
    return history.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def kept_since(history: DataFrame, cutoff: str) -> DataFrame:
    return history.where(F.col("completed_at") > F.lit(cutoff).cast("timestamp"))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with changes on top: the last row of each key by order."""
    return latest(current.unionByName(changes), keys, order)


def outliers(values: DataFrame, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartiles of their group by more than factor times their distance."""
    q = quantiles(values, group, value, {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * factor
    return values.join(q, group).where((F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread)).drop("q1", "q3")


#: Parts of a group's values that are counted before the ones that hold a quantile are sorted.
BUCKETS = 64


def quantiles(values: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column for each of shares: {name: share}): exact quantiles, interpolated between neighbours.

    Approximate bounds cut each group's values into parts, the parts are counted where the rows lie, and only those
    that hold a wanted place are sorted, so no task sees all values of a group. Null values don't count; a group
    without others has no row.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    cuts = rows.groupBy("g").agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts")).select(F.col("g").alias("cg"), "cuts")
    placed = rows.join(cuts, F.col("g").eqNullSafe(F.col("cg"))).select("g", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    # equal values are one row from here on
    counts = placed.groupBy("g", "part", "v").agg(F.count("*").alias("n"))
    parts = counts.groupBy("g", "part").agg(F.sum("n").alias("size"))
    whole, up_to = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("g", "part", "size", F.sum("size").over(whole).alias("total"), (F.sum("size").over(up_to) - F.col("size")).alias("ahead"))
    places = F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("total") - 1) * F.lit(s)).alias("at")) for n, s in shares.items()])
    inside = lambda p: (F.floor(p["at"]) < F.col("ahead") + F.col("size")) & (F.ceil(p["at"]) >= F.col("ahead"))
    wanted = parts.withColumn("places", F.filter(places, inside)).where(F.size("places") > 0).select(F.col("g").alias("wg"), F.col("part").alias("wpart"), "ahead", "places")
    met = counts.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("part") == F.col("wpart")))
    before = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("first", F.col("ahead") + F.sum("n").over(before) - F.col("n")).select("g", "v", "n", "first", F.explode("places").alias("p")).select("g", "v", "n", "first", "p.*")
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda at: (at >= F.col("first")) & (at < F.col("first") + F.col("n"))
    ends = met.groupBy("g", "name").agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"), F.max(F.col("at") - low).alias("rest"))
    ends = ends.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * F.col("rest"))
    return ends.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])


#: States in which a batch is over.
OVER = ("completed", "failed", "cancelled")


def batch_status(events: DataFrame) -> DataFrame:
    """(batch_id, status, at) of each batch's last event (batch_id, status, at, event_id)."""
    return latest(events, ["batch_id"], ["at", "event_id"]).select("batch_id", "status", "at")


def active(events: DataFrame) -> DataFrame:
    """Batches that aren't over."""
    return batch_status(events).where(~F.col("status").isin(*OVER))


def cancelled(events: DataFrame, batches: DataFrame, at: Column) -> DataFrame:
    """Events that cancel those of the batches that aren't over, to be added to the others."""
    return active(events).join(batches.select("batch_id"), "batch_id", "left_semi").select("batch_id", F.lit("cancelled").alias("status"), at.alias("at"))


def soft_deleted(documents: DataFrame, at: Column) -> DataFrame:
    """Events that mark documents as deleted; their rows and what hangs on them stay."""
    return documents.select("document_id", F.lit("deleted").alias("status"), at.alias("at"))


def document_events(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """(event, document_id, at) for listeners: document.created of each document, and ocr.completed, llm.completed or template.completed of each job that completed."""
    made = documents.select(F.lit("document.created").alias("event"), "document_id", F.col("created_at").alias("at"))
    kind = F.when(F.col("job_type").startswith("llm_"), "llm.completed").when(F.col("job_type") == "template", "template.completed").otherwise("ocr.completed")
    return made.unionByName(jobs.where("status = 'completed'").select(kind.alias("event"), "document_id", F.col("completed_at").alias("at")))


def valid_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with the names of the rules that they break; null counts as broken."""
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(fits, F.lit(False)), n) for n, fits in rules.items()])))


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys are among gone: a delete as a rewrite."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def current_status(documents: DataFrame, events: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Documents with the status of their last event (document_id, status, at, event_id); without events it stays, deleted ones are left out."""
    last = latest(events, ["document_id"], ["at", "event_id"]).select("document_id", F.col("status").alias("__status"))
    met = documents.join(last, "document_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
    return met.where(F.col("status") != deleted)
