"""Documents as a data source: pages of large files, read by several tasks a file, at once or as a stream.

A file is cut into byte ranges; a task reads the pages that begin in its range, so a file of any size is shared by many tasks
and no task holds more than a page and a buffer. An engine turns a page's bytes into text. Files are opened through
pyarrow, which knows local, HDFS and object stores by their address.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, begin long, place long, nth int, text string, confidence double, error string"
#: Bytes of a range and of a buffer; what parts pages: a form feed.
RANGE, BUFFER, SEPARATOR = 8 << 20, 1 << 20, b"\f"


#: Bytes of ranges that one task reads at least, where there are so many: short ranges share a task. Fewest tasks that ranges are dealt to, as far as they go.
TASK, TASKS = 8 << 20, 64


class Span(InputPartition):
    """A byte range of a file."""

    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class Spans(InputPartition):
    """Byte ranges that one task reads one after another."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = spans


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_opened = opened


def listed(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the files below a path, hidden ones left out, oldest first."""
    system, place = _opened(path)
    start = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, start + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


def pages_of(span: Span) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the pages that begin in a range: at its begin if a page ends right before it, and after every separator within it."""
    system, place = _opened(span.path)
    with system.open_input_file(place) as f:
        size, much = f.size(), min(BUFFER, max(4096, span.end - span.begin))  # no more than the range is likely to need
        at = max(0, span.begin - 1)
        f.seek(at)
        held, begin = b"", at
        if span.begin:  # the page before belongs to another range
            while True:
                more = f.read(much)
                cut = more.find(SEPARATOR)
                if cut >= 0:
                    held, begin = more[cut + 1 :], begin + cut + 1
                    break
                if not more:
                    return
                begin += len(more)
        while begin < span.end:
            cut, seen = held.find(SEPARATOR), 0
            parts = [held]
            while cut < 0:
                more = f.read(much)
                if not more:
                    break
                seen += len(parts[-1])
                parts.append(more)
                cut = more.find(SEPARATOR)
                cut = cut if cut < 0 else cut + seen
            held = b"".join(parts)
            if cut < 0:
                if begin < size:  # the last page has no separator behind it
                    yield begin, held
                return
            yield begin, held[:cut]
            held, begin = held[cut + 1 :], begin + cut + 1


def plain(content: bytes) -> list[tuple[str, float]]:
    """An engine for pages that are text; bytes that are no UTF-8 raise."""
    return [(content.decode(), 1.0)]


def _engine(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Pages:
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.last = options.get("last", "") == "true"
        self.range, self.engine = int(options.get("range", RANGE)), options.get("engine", "foliospark.sources.paged:plain")

    def spans(self, files: list[tuple[int, str, int]]) -> list[Span]:
        return [Span(path, a, min(size, a + self.range)) for _, path, size in files for a in range(0, size, self.range)]

    def dealt(self, spans: list[Span]) -> list[Spans]:
        """Short ranges share a task, up to TASK bytes, once there are enough tasks."""
        each = max(1, min(-(-len(spans) // TASKS), TASK // self.range))
        return [Spans(spans[n : n + each]) for n in range(0, len(spans), each)]

    def read(self, partition: Spans) -> Iterator[tuple]:
        read = _engine(self.engine)
        for span in partition.spans:
            nth = place = -1
            for nth, (place, content) in enumerate(pages_of(span)):
                if self.last:
                    continue
                try:
                    for text, confidence in read(content):
                        yield span.path, span.begin, place, nth, text, float(confidence), None
                except Exception as broken:  # noqa: BLE001  one bad page must not end the job
                    yield span.path, span.begin, place, nth, None, 0.0, str(broken)
            if self.last and nth >= 0:
                yield span.path, span.begin, place, nth, None, 0.0, None


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Spans]:
        return self.dealt(self.spans(listed(self.path, self.suffix))) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[tuple]:
        return super().read(partition)


class _Stream(_Pages, DataSourceStreamReader):
    """The offset is the time and the name of the last file that has been read."""

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.suffix)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        after, until = (start["time"], start["name"]), (end["time"], end["name"])
        return self.dealt(self.spans([f for f in listed(self.path, self.suffix) if after < f[:2] <= until]))

    def commit(self, end: dict) -> None: ...


class PagedSource(DataSource):
    """Format "foliopages". Options: path, suffix of the files' names, range (bytes), last (true: only the last page of each range, unread), engine ("module:function": bytes of a page to [(text, confidence), ...]).

    A row for each text that the engine finds on a page; a page on which it fails is a row with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "foliopages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pages below a path, with their number within the file: path, page_number, text, confidence, error. The files are read twice: pages are counted first."""
    spark.dataSource.register(PagedSource)
    source = spark.read.format("foliopages").options(path=path, **{k: str(v) for k, v in options.items()})
    rows = source.load()
    return numbered(rows, source.option("last", "true").load())


def page_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pages of files as they come; a page is known by path and place."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("foliopages").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def numbered(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Numbers pages from 1 through a file: those of its earlier ranges, of which last holds the last page, are added to a page's place in its own.

    last has a row for each range, as the driver's list of ranges has, so it goes to the tasks and the pages stay where they are.
    """
    ranges = last.select(F.col("path").alias("p"), F.col("begin").alias("b"), (F.col("nth") + 1).alias("n"))
    ranges = ranges.withColumn("ahead", F.expr("coalesce(sum(n) over (partition by p order by b rows between unbounded preceding and 1 preceding), 0)"))
    met = rows.join(F.broadcast(ranges), (F.col("path") == F.col("p")) & (F.col("begin") == F.col("b")))
    return met.select("path", (F.col("ahead") + F.col("nth") + 1).cast("int").alias("page_number"), "text", "confidence", "error")
