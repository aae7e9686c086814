"""Event-time windows of a stream: each row counts once, in windows that close behind a watermark, or is kept as late.

Two streams work one behind the other. The first deals each micro-batch out into rows that are on time and rows that are
late, against the greatest time of all earlier batches, which it notes with each batch. The second reads the rows on
time, counts them in windows and writes a window once, when the watermark has passed its end. All state is Spark's own
or a table; nothing is kept in the driver's memory.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(time: str, width: str, slide: str | None = None, gap: str | None = None) -> tuple[Column, Column]:
    """The window column of a row (tumbling, sliding or session) and the time from which on the row is late for all of its windows.

    width, slide and gap are fixed lengths such as "6 hours".
    """
    if gap is not None:  # what comes before the watermark could belong to a session that is closed
        return F.session_window(time, gap), F.col(time) + F.expr("interval 1 microsecond")
    step, whole = (pd.Timedelta(x).value // 1000 for x in (slide or width, width))
    # the last window of a row begins at the last step before it; window() itself would drop rows without a time
    until = F.timestamp_micros(F.floor(F.unix_micros(time) / step) * F.lit(step) + F.lit(whole))
    return F.window(time, width, slide) if slide else F.window(time, width), until


def split_late(stream: DataFrame, time: str, until: Column, delay: str, path: str, checkpoint: str) -> None:
    """Writes all that is there now below path: on_time and late, a folder for each batch, and marks, the greatest time after it.

    A row is late if until (see windows) lies at or before the greatest time of earlier batches less delay. A batch that comes again
    replaces its own folders. Rows without a time are late.
    """
    spark = stream.sparkSession

    def deal(batch: DataFrame, number: int) -> None:
        try:
            high = spark.read.parquet(f"{path}/marks").where(F.col("batch") < number).agg(F.max("high")).first()[0]
        except AnalysisException:  # the first batch
            high = None
        past = F.lit(False) if high is None else until <= F.lit(high) - F.expr(f"interval {delay}")
        marked = batch.withColumn("__late", past | F.col(time).isNull())
        for name, rows in (("on_time", marked.where("not __late")), ("late", marked.where("__late"))):
            rows.drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.agg(F.greatest(F.max(time), F.lit(high).cast("timestamp")).alias("high")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_windows(spark: SparkSession, path: str, schema, time: str, window: Column, delay: str, keys: list[str]) -> None:
    """Counts the rows on time below path by window and keys, and adds each window that has closed to path/windows, once."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/on_time")
    counted = rows.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
    counted.writeStream.outputMode("append").format("parquet").option("path", f"{path}/windows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def windowed(stream: DataFrame, time: str, path: str, delay: str, keys: list[str], width: str = "1 day", slide: str | None = None, gap: str | None = None) -> None:
    """All that is there now of a stream, then ends; a later run goes on after it. path/windows holds closed windows, path/late the rows that came too late."""
    window, until = windows(time, width, slide, gap)
    split_late(stream, time, until, delay, path, f"{path}/dealt")
    run_windows(stream.sparkSession, path, stream.schema, time, window, delay, keys)
