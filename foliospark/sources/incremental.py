"""Pulling changed rows a page at a time, each once, behind a cursor that is kept with the pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Puller:
    """Pages of rows in order of (time, id), written below a path with the cursor that each ends at.

    path/pages/page=N holds the rows, path/cursors/page=N one row: the greatest (time, id) so far and the number of rows. A
    page counts once its cursor is written; what a lost run left without one is written again. Rows that come late (their
    time lies before the cursor) are found again as long as it lies within overlap of it: that stretch is read anew and
    what earlier pages hold of it is left out.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "updated_at", key: str = "document_id", overlap: str = "1 hour") -> None:
        self.spark, self.path, self.time, self.key, self.overlap = spark, path, time, key, overlap

    def cursors(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/cursors")
        except AnalysisException:  # nothing pulled yet
            return None

    def cursor(self) -> tuple:
        """(pages, time, id) of the last page."""
        known = self.cursors()
        last = known.agg(F.max("page") + 1, F.max(F.struct("time", "id"))).first() if known is not None else None
        return (last[0], last[1]["time"], last[1]["id"]) if last is not None and last[0] is not None else (0, None, None)

    def pull(self, rows: DataFrame, limit: int = 100) -> int:
        """Writes the next page of rows, limit of them at most, and returns how many there were. Rows without time or id are left aside."""
        pages, time, key = self.cursor()
        rows = rows.where(F.col(self.time).isNotNull() & F.col(self.key).isNotNull())
        if pages:
            # the filter on time alone reaches the scan; the pair of columns is the exact bound
            again = F.lit(time) - F.expr(f"interval {self.overlap}")
            rows = rows.where(F.col(self.time) >= again)
            seen = self.spark.read.parquet(f"{self.path}/pages").where((F.col("page") < pages) & (F.col(self.time) >= again)).select(self.time, self.key)
            past = F.struct(F.col(self.time), F.col(self.key)) > F.struct(F.lit(time).alias(self.time), F.lit(key).alias(self.key))
            late = rows.where(~past).join(seen, [self.time, self.key], "left_anti").select(*rows.columns)
            rows = rows.where(past).unionByName(late)
        page = rows.orderBy(self.time, self.key).limit(limit)
        page.write.mode("overwrite").parquet(f"{self.path}/pages/page={pages}")
        written = self.spark.read.schema(page.schema).parquet(f"{self.path}/pages/page={pages}")
        own = F.max(F.struct(F.col(self.time).alias("time"), F.col(self.key).alias("id")))
        n = written.count()
        if n:  # late rows lie before the cursor, which never goes back
            before = F.struct(F.lit(time).alias("time"), F.lit(key).alias("id")) if pages else own
            end = written.agg(F.greatest(own, before).alias("end"))
            end.select("end.*", F.lit(n).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/cursors/page={pages}")
        return n

    def pulled(self) -> DataFrame:
        """All rows of the pages that count, each with the number of its page."""
        pages = self.cursor()[0]
        return self.spark.read.parquet(f"{self.path}/pages").where(F.col("page") < pages)


def pull_all(spark: SparkSession, rows: DataFrame, path: str, limit: int, **options) -> DataFrame:
    """Page after page until one is empty."""
    puller = Puller(spark, path, **options)
    while puller.pull(rows, limit):
        pass
    return puller.pulled()
