"""Document lists and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("uploaded", "processing", "completed", "failed", "deleted")
MOST = 100


def listed(documents: DataFrame, owner=None, status: str | None = None, sort: str | list[str] = "-upload_date", skip: int = 0, limit: int | None = MOST, statuses: tuple = STATUSES) -> DataFrame:
    """A page of documents, newest first unless sort says otherwise ("-" before a column: descending; several in a list), ids breaking ties.

    limit: 100 at most, None for all rows, which are then sorted over all partitions.

    Filters count only where they are given; without a status deleted documents are left out; unknown ones raise.
    """
    if status is not None and status not in statuses:
        raise ValueError(f"status {status!r} is none of {statuses}")
    found = documents if owner is None else documents.where(F.col("uploaded_by") == owner)
    found = found.where(F.col("status") != "deleted") if status is None else found.where(F.col("status") == status)
    keys = [F.col(s.lstrip("-")).desc() if s.startswith("-") else F.col(s).asc() for s in ([sort] if isinstance(sort, str) else sort)]
    ordered = found.orderBy(*keys, "document_id")
    ordered = ordered.offset(skip) if skip else ordered
    return ordered if limit is None else ordered.limit(min(limit, MOST))


def page_count(documents: DataFrame, limit: int) -> DataFrame:
    """One row: number of documents and of pages."""
    return documents.agg(F.count("*").alias("total"), F.ceil(F.count("*") / limit).alias("pages"))


def searched(documents: DataFrame, words: str | None = None, columns: str | tuple = "text", since: str | None = None, until: str | None = None, kind: str | None = None, date: str = "upload_date", kind_column: str = "file_type") -> DataFrame:
    """Documents with the words (case ignored) in any of the columns, dated from since to until (both included), of a kind. What isn't given doesn't count."""
    found = documents
    if words is not None:
        where = F.lit(False)
        for c in [columns] if isinstance(columns, str) else columns:
            where = where | F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False))
        found = found.where(where)
    if since is not None:
        found = found.where(F.col(date) >= F.lit(since))
    if until is not None:
        found = found.where(F.col(date) <= F.lit(until))
    return found if kind is None else found.where(F.col(kind_column) == kind)


def with_outcome(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documents with the columns of their results and a status: processed, or not_processed where there is none."""
    met = documents.join(results.withColumn("__found", F.lit(True)), "document_id", "left")
    return met.withColumn("outcome", F.when(F.col("__found"), "processed").otherwise("not_processed")).drop("__found")


def missing_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file (path) isn't among the files there are."""
    return documents.join(files.select("path"), "path", "left_anti")


def projected(documents: DataFrame, flags: dict[str, bool], always: tuple = ("document_id",)) -> DataFrame:
    """Only the columns that are asked for, for an export: flags: {column: whether to include it}."""
    return documents.select(*always, *[c for c, wanted in flags.items() if wanted])


def with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each document with its jobs, newest first, as an array of (created_at, job_id, job_type)."""
    nested = jobs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "job_id", "job_type")), asc=False).alias("jobs"))
    return documents.join(nested, "document_id", "left")


def without(documents: DataFrame, results: DataFrame) -> DataFrame:
    return documents.join(results, "document_id", "left_anti")
