"""A table of the last row of each key, kept up in place: a merge writes only the buckets that its changes touch.

path/data/version=V/bucket=B holds a bucket as merge V left it. path/manifest/version=V is one small table that says for every bucket
which version holds it; it counts once Spark has marked it as complete, so a merge is there as a whole or not at all.
Reading costs the present rows however many merges there were. Versions that no manifest in use names are deleted.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import jobs


class MergedTable:
    """buckets: keys are dealt into so many by hash; a merge rewrites each that it touches, and a manifest has a row for each. It is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets, self.keep = spark, path, keys, order, buckets, keep

    @cached_property
    def _fs(self):
        return self._place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Versions whose manifest is complete, oldest first."""
        found = self._fs.globStatus(self._place(f"{self.path}/manifest/version=*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)

    def _manifest(self, version: int) -> list:
        return self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()  # a row for each bucket

    def holds(self, batch: int) -> bool:
        """Whether a merge of this number, or a later one, is in the table."""
        known = self._manifest(versions[-1]) if (versions := self.versions()) else []
        return bool(known) and known[0]["batch"] is not None and known[0]["batch"] >= batch

    def _rows(self, places: list, schema) -> DataFrame:
        paths = [f"{self.path}/data/version={r['version']}/bucket={r['bucket']}" for r in places]
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, changes: DataFrame, batch: int | None = None) -> int:
        """Puts changes on top and returns the version that holds them.

        Of each key the last row by order stays, so rows that come late or again change nothing. batch: a number that grows
        from merge to merge; one that is in the table already, as after a lost run, is left out. Rows with a null in keys are keys of their own.
        """
        versions = self.versions()
        version, known = (versions[-1] + 1, self._manifest(versions[-1])) if versions else (0, [])
        if batch is not None and known and known[0]["batch"] is not None and known[0]["batch"] >= batch:
            return version - 1
        dealt = jobs.latest(changes, self.keys, self.order).select(*changes.columns).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = {r[0] for r in dealt.select("bucket").distinct().collect()}  # buckets at most
        own = [r for r in known if r["bucket"] in touched]
        if own:
            before = self._rows(own, changes.schema).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            dealt = jobs.latest(before.unionByName(dealt), [*self.keys, "bucket"], self.order).select(*dealt.columns)
        dealt.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        now = {r["bucket"]: r["version"] for r in known} | dict.fromkeys(touched, version)
        rows = [(b, v, batch) for b, v in sorted(now.items())]
        self.spark.createDataFrame(rows, "bucket int, version int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._drop_unused([*versions, version])
        return version

    def _drop_unused(self, versions: list[int]) -> None:
        """Deletes manifests but the last ones, and buckets that none of those names."""
        for old in versions[: -self.keep]:
            self._fs.delete(self._place(f"{self.path}/manifest/version={old}"), True)
        used = {(r["version"], r["bucket"]) for v in versions[-self.keep :] for r in self._manifest(v)}
        for found in self._fs.globStatus(self._place(f"{self.path}/data/version=*/bucket=*")) or []:
            bucket, version = (int(p.getName().split("=")[1]) for p in (found.getPath(), found.getPath().getParent()))
            if (version, bucket) not in used and version <= versions[-1]:
                self._fs.delete(found.getPath(), True)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows as the last merge, or one of the last ones, left them. schema: that of the changes."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self._rows(self._manifest(versions[-1] if version is None else version), schema)

    def size(self) -> int:
        """Bytes that a read goes over."""
        versions = self.versions()
        return sum(self._fs.getContentSummary(self._place(f"{self.path}/data/version={r['version']}/bucket={r['bucket']}")).getLength() for r in self._manifest(versions[-1])) if versions else 0
