"""Streaming ingestion: new files once each, idempotent upserts, events for listeners, progress."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from foliospark.sinks.merged import MergedTable


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of files; the schema comes from the files there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; where that is unset, one of this machine in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/foliospark/stream-{uuid.uuid4().hex}"


def run_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """All that is there now merged into the table at path, then ends; a later run goes on after it.

    The table is the only state: each micro-batch rewrites the buckets of the keys that it changed, and one that comes again changes nothing.
    """
    table = MergedTable(stream.sparkSession, path, keys, order, buckets)
    stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str], schema) -> DataFrame:
    """The table that run_upsert() keeps up."""
    return MergedTable(spark, path, keys, order).read(schema)


def run_events(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Event rows (event, document_id, at) of a stream added to a table for listeners, each once."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Calls back with the number of rows of each micro-batch; what the callback raises is swallowed."""

    def __init__(self, callback: Callable[[int, int], None]) -> None:
        self.callback = callback

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        with contextlib.suppress(Exception):
            self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
