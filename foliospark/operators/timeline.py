"""Joins and neighbours along time: intervals, as-of, status histories.

Nothing here sorts or joins all rows of a key in one task. Rows of a key are dealt out by time bins as well; what one bin
hands to another (its first or last row) is a row for each bin. Joins are equality joins on (key, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a document and those that may follow; None stands for no state before.
LEGAL = {
    None: ("uploaded",),
    "uploaded": ("processing", "deleted"),
    "processing": ("completed", "failed"),
    "completed": ("processing", "deleted"),
    "failed": ("processing", "deleted"),
    "deleted": (),
}


def _neighbour(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], name: str, unit: str, later: bool) -> DataFrame:
    """rows with a struct of columns of the next (later) or the last row of the key by at and order; null where there is none.

    Within a bin (a unit of time) a window finds it; the last (first) row of a bin gets the nearest one of the bins after (before) it.
    """
    own = rows.withColumn("__bin", F.date_trunc(unit, F.col(at)))
    by, value = [at, *order], F.struct(*columns)
    within = Window.partitionBy(key, "__bin").orderBy(*by)
    own = own.withColumn(name, F.lead(value).over(within) if later else F.lag(value).over(within))
    edge = (F.min_by if later else F.max_by)(value, F.struct(*by)).alias("__edge")
    over = Window.partitionBy("__key").orderBy("__at")
    bins = rows.groupBy(F.col(key).alias("__key"), F.date_trunc(unit, F.col(at)).alias("__at")).agg(edge)
    bins = bins.withColumn("__edge", F.lead("__edge").over(over) if later else F.lag("__edge").over(over))
    met = own.join(bins, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bin").eqNullSafe(F.col("__at")), "left")
    return met.withColumn(name, F.coalesce(name, "__edge")).drop("__bin", "__key", "__at", "__edge")


def with_next(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], name: str = "next", unit: str = "day") -> DataFrame:
    return _neighbour(rows, key, at, order, columns, name, unit, True)


def with_last(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], name: str = "last", unit: str = "day") -> DataFrame:
    return _neighbour(rows, key, at, order, columns, name, unit, False)


def status_history(events: DataFrame, legal: dict = LEGAL, unit: str = "day") -> DataFrame:
    """Status events (document_id, status, at, event_id) to intervals: document_id, was, status, valid_from, valid_to, legal.

    Events that repeat the status change nothing. valid_to is null for the status that still holds; was is the status
    that it took over from, null for the first one; legal says whether legal lists that step. Several changes of one
    moment are kept in order of event_id; all but the last last no time.
    """
    known = with_last(events.where("at is not null"), "document_id", "at", ["event_id"], ["status"], "__was", unit)
    changes = known.where(~F.col("__was.status").eqNullSafe(F.col("status")) | F.col("__was").isNull())
    met = with_next(changes, "document_id", "at", ["event_id"], ["at"], "__next", unit)
    step = F.coalesce(F.col("__was.status"), F.lit("")).alias("a"), F.coalesce(F.col("status"), F.lit("")).alias("b")
    allowed = F.lit(False)
    for a, following in legal.items():
        if following:
            allowed = allowed | ((step[0] == (a or "")) & step[1].isin(*following))
    return met.select("document_id", F.col("__was.status").alias("was"), "status", F.col("at").alias("valid_from"), F.col("__next.at").alias("valid_to"), allowed.alias("legal"), "event_id")


def illegal_steps(history: DataFrame) -> DataFrame:
    """Changes that no rule allows, to be reported."""
    return history.where(~F.col("legal")).select("document_id", "was", "status", F.col("valid_from").alias("at"))


def time_in_status(history: DataFrame, until: Column) -> DataFrame:
    """Seconds that each document was in each status; what still holds is counted up to until."""
    end = F.coalesce("valid_to", until.cast("timestamp"))
    return history.groupBy("document_id", "status").agg(F.sum(F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros("valid_from")) / 1e6).alias("seconds"))


def status_times(events: DataFrame, started: tuple = ("started", "processing"), ended: tuple = ("success", "failure", "completed", "failed")) -> DataFrame:
    """(document_id, status, started_at, completed_at) after all events: the first start counts, the last end, and the last status. One aggregate."""
    when = lambda states: F.when(F.col("status").isin(*states), F.col("at"))
    return events.groupBy("document_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.min(when(started)).alias("started_at"), F.max(when(ended)).alias("completed_at"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, tie: str, columns: list[str], unit: str = "day") -> DataFrame:
    """Each row of left with columns of the last row of right with its key at or before its time; null where there is none.

    Of right rows of one moment the one with the greatest tie counts. Right rows without key or time are left aside;
    left rows without them stay, with nulls.
    """
    picked, rest = F.struct(*columns), [c for c in left.columns if c not in (key, at)]
    kind = left.schema[key].dataType
    asks = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*rest).alias("__row"))
    says = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).cast(kind).alias("__k"), F.col(right_at).cast(left.schema[at].dataType).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), picked.alias("__right"))
    both = asks.unionByName(says, allowMissingColumns=True).withColumn("__bin", F.date_trunc(unit, F.col("__t")))
    so_far = Window.partitionBy("__k", "__bin").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__near", F.last("__right", ignorenulls=True).over(so_far)).where("__side = 1")
    bins = both.groupBy(F.col("__k").alias("__bk"), F.col("__bin").alias("__bb")).agg(F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__end"))
    earlier = Window.partitionBy("__bk").orderBy("__bb").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__end", F.last("__end", ignorenulls=True).over(earlier))
    out = met.join(bins, F.col("__k").eqNullSafe(F.col("__bk")) & F.col("__bin").eqNullSafe(F.col("__bb")), "left")
    there = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__near", "__end"))
    names = {c: F.col(f"__row.`{c}`") for c in rest} | {key: F.col("__k"), at: F.col("__t")}
    return out.select(*[names[c].alias(c) for c in left.columns], there.alias("__found")).select(*left.columns, *[F.col(f"__found.`{c}`").alias(c) for c in columns])


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, base: float = 3600.0, how: str = "inner") -> DataFrame:
    """points (key, at, ...) with the columns of every interval (key, start, end, ...) of their key with start <= at < end; an interval without an end goes on.

    Time is cut into bins of base seconds and its doubles. An interval goes to the bins that it touches at the first
    width as long as itself, two at most; a point goes to its bin at each width that intervals have, some thirty at
    most. So copies are bounded whatever the lengths, and a key with most rows is dealt out by bin. Besides the key no column
    name may be in both. how: "inner" or "left" (points without an interval stay, with nulls).
    """
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    length = F.greatest(F.coalesce(second(end), F.lit(2.0**40)) - second(start), F.lit(base))
    own = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    own = own.withColumn("__level", F.ceil(F.log2(length / base) - 1e-9).cast("int"))
    width = lambda level: F.lit(float(base)) * F.pow(F.lit(2.0), level)
    first = F.floor(second(start) / width(F.col("__level")))
    last = F.when(F.col(end).isNull(), first + 1).otherwise(F.floor(second(end) / width(F.col("__level"))))
    own = own.withColumn("__bin", F.explode(F.sequence(first, last)))
    levels = sorted(r[0] for r in own.select("__level").distinct().collect())  # powers of two between an hour and all time
    rows = points if how == "inner" else points.withColumn("__n", F.monotonically_increasing_id())
    asked = rows.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    asked = asked.withColumn("__bin", F.floor(second(at) / width(F.col("__level"))))
    own = own.withColumnsRenamed({key: "__key", "__level": "__l", "__bin": "__b"})
    inside = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    met = asked.join(own, (F.col(key) == F.col("__key")) & (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b")) & inside).drop("__key", "__level", "__bin", "__l", "__b")
    if how == "inner":
        return met
    lone = rows.join(met.select("__n").distinct(), "__n", "left_anti")
    return met.unionByName(lone, allowMissingColumns=True).drop("__n")
