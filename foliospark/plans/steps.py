"""Steps over documents that go on where they stopped.

Steps make a small graph. What a step gives for a document is kept below path/step/run=N, with an error where it failed; a
run takes, for each step, the documents that its forerunners have done and it has not. So a rerun does new and
failed documents only, and steps that don't wait for one another run side by side. A run that is lost leaves no complete folder and is
done again.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step: tables by name (documents, and one for each forerunner) to document_id, its own columns and error (null where it went well).
Step = Callable[[dict[str, DataFrame]], DataFrame]


class Steps:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.steps: dict[str, tuple[Step, list[str]]] = {}

    def add(self, name: str, step: Step, after: tuple | list = ()) -> Steps:
        """Adds a step; forerunners have to be there already, so the graph has no circle."""
        if unknown := set(after) - set(self.steps):
            raise ValueError(f"unknown forerunners: {sorted(unknown)}")
        self.steps[name] = step, list(after)
        return self

    def runs(self, name: str) -> list[int]:
        """Numbers of the step's complete runs."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/run=*/_SUCCESS")
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(top) or []
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)

    def results(self, name: str, failed: bool = False) -> DataFrame | None:
        """What the step gave, a row for each document, with the run; failed: its failures, one for each attempt. None before its first run."""
        runs = self.runs(name)
        if not runs:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/run={n}" for n in runs])
        return rows.where(F.col("error").isNotNull() if failed else F.col("error").isNull())

    def _todo(self, documents: DataFrame, name: str) -> DataFrame:
        todo = documents
        for before in self.steps[name][1]:
            todo = todo.join(self.results(before).select("document_id").hint("merge"), "document_id", "left_semi")
        own = self.results(name)
        return todo if own is None else todo.join(own.select("document_id").hint("merge"), "document_id", "left_anti")

    def _run(self, documents: DataFrame, name: str, run: int) -> None:
        step, after = self.steps[name]
        todo = self._todo(documents, name)
        own = todo.select("document_id").hint("merge")
        tables = {"documents": todo} | {b: self.results(b).drop("error", "run").join(own, "document_id", "left_semi").hint("merge") for b in after}
        step(tables).write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def run(self, documents: DataFrame) -> int:
        """Runs every step over what is left for it and returns the run's number. documents: one row for each document_id."""
        run = max((max(self.runs(n), default=-1) for n in self.steps), default=-1) + 1
        done: set[str] = set()
        while len(done) < len(self.steps):
            ready = [n for n, (_, after) in self.steps.items() if n not in done and done.issuperset(after)]
            with ThreadPoolExecutor(len(ready)) as side_by_side:
                list(side_by_side.map(lambda n: self._run(documents, n, run), ready))
            done.update(ready)
        return run

    def manifest(self) -> DataFrame:
        """(document_id, step, state, attempts, run): done or failed, how often it was tried, and the last run that tried it."""
        parts = []
        for name in self.steps:
            for failed in (False, True):
                rows = self.results(name, failed)
                if rows is not None:
                    parts.append(rows.select("document_id", F.lit(name).alias("step"), F.lit(not failed).alias("good"), "run"))
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.union(more)
        tried = whole.groupBy("document_id", "step").agg(F.max("good").alias("good"), F.count("*").alias("attempts"), F.max("run").alias("run"))
        return tried.select("document_id", "step", F.when(F.col("good"), "done").otherwise("failed").alias("state"), "attempts", "run")
