"""Sources: files with their metadata, rendered pages, templates, tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import normalize
from foliospark.sinks.merged import MergedTable
from foliospark.sources.paged import opened


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path: name, type, MIME type, size, hash, year and month (to partition by) and content."""
    return _described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def _described(found: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        "path", name.alias("filename"), normalize.extension(name).alias("file_type"), normalize.mime_type(name).alias("mime_type"), F.col("length").alias("file_size"),
        "modificationTime", F.year("modificationTime").alias("year"), F.month("modificationTime").alias("month"), F.sha2("content", 256).alias("sha256"), "content",
    )


#: Files of a folder that write_files() aims at.
FOLDER_FILES = 500


def write_files(rows: DataFrame, path: str, folders: int) -> DataFrame:
    """(name, content binary) to a file each below path, in so many folders by the name's hash, written by the tasks, and gives the folders (folder, files).

    Many small files are neither moved nor listed by the driver. Names are distinct; a task that runs again writes the same files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = opened(path)
        made: dict[str, int] = {}
        for batch in batches:
            for folder, name, content in batch.itertuples(index=False):
                if folder not in made:
                    system.create_dir(f"{top}/{folder}", recursive=True)
                with system.open_output_stream(f"{top}/{folder}/{name}") as f:
                    f.write(content)
                made[folder] = made.get(folder, 0) + 1
        yield pd.DataFrame([(f"{path}/{x}", n) for x, n in made.items()], columns=["folder", "files"])

    dealt = rows.select(F.concat(F.lit("f"), F.pmod(F.xxhash64("name"), F.lit(folders))).alias("folder"), "name", "content")
    return dealt.repartition(min(folders, 1000), "folder").mapInPandas(write, "folder string, files long")


def files_of(folders: DataFrame, suffix: str = "") -> DataFrame:
    """As binary_files(), of a table of folders (folder): each is listed and read by a task, so the driver holds no list of files."""

    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                system, top = opened(folder)
                begin = folder[: len(folder) - len(top)] if folder.endswith(top) else ""
                rows, held = [], 0
                for f in system.get_file_info(fs.FileSelector(top)):
                    if f.type != fs.FileType.File or not f.path.endswith(suffix) or f.base_name.startswith(("_", ".")):
                        continue
                    with system.open_input_stream(f.path) as stream:
                        content = stream.read()
                    rows.append((begin + f.path, f.mtime, len(content), content))
                    held += len(content)
                    if held > 16 << 20 or len(rows) == 1000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return _described(folders.select("folder").mapInArrow(read, "path string, modificationTime timestamp, length long, content binary"))


def ingested(files: DataFrame, path: str) -> None:
    """Files (as binary_files gives them) added to a table partitioned by the year and month they came, each under a name of its own."""
    files.withColumn("stored_name", F.concat_ws(".", F.expr("uuid()"), "file_type")).write.mode("append").partitionBy("year", "month").parquet(path)


def read_pages(files: DataFrame, engine: Callable[[bytes, str], list[tuple[str, float]]]) -> DataFrame:
    """(path, file_type, content) to one row per page by a recognition engine: (content, type) -> [(text, confidence), ...].

    A file on which the engine fails gives one row with page_number 0 and the error.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in batch.itertuples(index=False):
                try:
                    rows += [(path, n, text, float(confidence), None) for n, (text, confidence) in enumerate(engine(content, kind), 1)]
                except Exception as broken:  # noqa: BLE001  one bad file must not end the job
                    rows.append((path, 0, None, 0.0, str(broken)))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "confidence", "error"])

    return files.select("path", "file_type", "content").mapInPandas(pages, "document_id string, page_number int, text string, confidence double, error string")


def _templates(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, description string, template string, variables array<string>, broken string"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    return read.withColumn("path", F.input_file_name())


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates from JSON files, and those that store_templates() keeps; files that aren't JSON objects with a name are left out, see broken_templates()."""
    written = _templates(spark, path).where("name is not null").drop("broken", "path")
    return written.unionByName(_stored(spark, path).read(_STORED).where("not gone").select(written.columns))


def broken_templates(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files that templates() leaves out."""
    bad = _templates(spark, path).select("path", "name", "broken").where("name is null")
    return bad.select("path", F.when(F.col("broken").isNotNull(), "not JSON").otherwise("no name").alias("reason"))


#: Rows of the table of stored templates: the last one of a name counts; gone: it was removed.
_STORED = "name string, description string, template string, variables array<string>, gone boolean, nth long"


def _stored(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, f"{path}/stored", ["name"], ["nth"])


def store_templates(rows: DataFrame, path: str) -> None:
    """Writes templates (name, description, template) beside the others, into a merged table below path; those of the same names are replaced.

    Only the buckets of the given names are written, so many templates are few files.
    """
    variables = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1)))
    _put(rows.select("name", "description", "template", variables.alias("variables"), F.lit(False).alias("gone")), path)


def _put(rows: DataFrame, path: str) -> None:
    stored = _stored(rows.sparkSession, path)
    stored.merge(rows.dropDuplicates(["name"]).withColumn("nth", F.lit(max(stored.versions(), default=-1) + 1).cast("long")))
    rows.sparkSession.catalog.refreshByPath(path)


def add_template(spark: SparkSession, path: str, name: str, template: str, description: str = "") -> None:
    """Writes a template beside the others; one of that name is replaced."""
    store_templates(spark.createDataFrame([(name, description, template)], "name string, description string, template string"), path)


def remove_templates(names: DataFrame, path: str) -> None:
    """Removes the stored templates of these names; other names change nothing."""
    kept = _stored(names.sparkSession, path).read(_STORED).where("not gone")
    known = kept.join(names.select("name").distinct(), "name", "left_semi")
    _put(known.select("name", "description", "template", "variables", F.lit(True).alias("gone")), path)


def remove_template(spark: SparkSession, path: str, name: str) -> bool:
    """Removes a stored template; whether there was one."""
    if _stored(spark, path).read(_STORED).where((F.col("name") == name) & ~F.col("gone")).isEmpty():
        return False
    remove_templates(spark.createDataFrame([(name,)], "name string"), path)
    return True


def template(spark: SparkSession, path: str, name: str) -> str:
    """The text of a template; an unknown name raises and says which there are."""
    known = {r["name"]: r["template"] for r in templates(spark, path).select("name", "template").collect()}
    if name not in known:
        raise KeyError(f"no template {name!r}; there are {sorted(known)}")
    return known[name]


def updated_since(documents: DataFrame, since: str | Column, limit: int = 100) -> DataFrame:
    """Completed documents changed after a time, oldest first, to be pulled a page at a time."""
    after = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    return documents.where((F.col("status") == "completed") & (F.col("updated_at") > after)).orderBy("updated_at", "document_id").limit(limit)


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object of settings with defaults for what it lacks; nested objects are completed too. Read on the driver: it's one small file."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])

    def completed(own: dict, base: dict) -> dict:
        return base | {k: completed(v, base[k]) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}

    return completed(given, defaults)
