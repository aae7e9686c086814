"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package: blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Values that a hash is folded to before it is held against a threshold.
_HASHES = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of this machine in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of df written as Parquet to the shared folder and read back, which cuts the lineage.

    A lost executor costs no more than the tasks that read the table; the plan above starts from files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by stored(), when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow_batches(df: DataFrame, rows: int = 2000, size: int | None = None) -> DataFrame:
    """df, with the session's batches for Python functions held to so many rows, and to size bytes where it is given: whole texts are wide, and a worker holds a few copies of a batch.

    Spark reads the setting when a plan runs, which is after this package has returned it, so it stays lowered for the
    session; a lower one of the user's is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    if size is not None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as decimal text, modulo parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % F.lit(parts)


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, group: str, order: str, most: int, most_groups: int = 1000) -> DataFrame:
    """The rows of each group with the most smallest values of order, a hash: most rows a group at most, chosen alike on every run.

    Rows equal in all columns count once, and the bound is measured on distinct hashes, so a group of many copies of
    few rows keeps them all. Each group's number of hashes is estimated where the rows lie; a threshold of about eight
    times most hashes then thins the rows before any of them is moved, so no task reads a large group. A threshold
    that leaves a group fewer than most of its hashes (by the estimate's error) is lifted for that group. Groups are
    the classes that a model learns: more than most_groups raise. Rows with a null group or order are left out.
    """
    place = F.pmod(F.col(order), F.lit(_HASHES))
    rows = df.where(F.col(group).isNotNull() & F.col(order).isNotNull())
    found = rows.groupBy(group).agg(F.approx_count_distinct(order).alias("n")).limit(most_groups + 1).collect()
    if len(found) > most_groups:
        raise ValueError(f"more than {most_groups} groups in {group}")
    if not found:
        return rows
    below = {r[0]: min(_HASHES, int(_HASHES * 8 * most / max(1, r["n"]))) for r in found}

    def thinned(limits: dict) -> DataFrame:
        limit = F.coalesce(*[F.when(F.col(group) == g, F.lit(n)) for g, n in limits.items()])
        return rows.where(place < limit)

    if any(n < _HASHES for n in below.values()):
        left = {r[0]: r["n"] for r in thinned(below).groupBy(group).agg(F.count_distinct(order).alias("n")).collect()}
        below = {g: n if left.get(g, 0) >= most else _HASHES for g, n in below.items()}
    numbered = thinned(below).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(place, *df.columns)))
    return numbered.where(F.col("__n") <= most).drop("__n")
