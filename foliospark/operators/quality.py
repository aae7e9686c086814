"""Rules across rows, and duplicates that aren't equal.

Violations come with the rows that make them. Duplicates are looked for among neighbours in several sorted orders, so no group is
ever compared as a whole: an order costs a sort and, for each row, a fixed number of comparisons. What is alike is joined up over
any number of steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.streaming.ingest import scratch

#: Following rows of an order that a row is compared with.
NEIGHBOURS = 4


def _broken(rows: DataFrame, row_id: str, rule: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(row_id).cast("string").alias("row_id"), detail.cast("string").alias("detail"))


def not_unique(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """Rows that share all keys with another; nulls aren't compared. detail: the keys."""
    known = rows.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    shared = known.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return _broken(known.join(shared, keys), row_id, f"unique {', '.join(keys)}", F.concat_ws(", ", *keys))


def not_dependent(rows: DataFrame, row_id: str, keys: list[str], column: str) -> DataFrame:
    """Rows of those keys that don't have one value of column alone (a null is a value). detail: the row's value."""
    value = F.struct(F.col(column).isNull().alias("empty"), F.col(column).alias("value"))
    odd = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high")).where("__low <> __high").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return _broken(rows.join(odd, same, "left_semi"), row_id, f"{', '.join(keys)} gives {column}", F.col(column))


def not_referring(rows: DataFrame, row_id: str, column: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose value of column is none of others; nulls refer to nothing. detail: the value."""
    known = others.select(F.col(other).alias("__other")).distinct()
    return _broken(rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__other"), "left_anti"), row_id, f"{column} refers", F.col(column))


def likeness(a: Column, b: Column) -> Column:
    """1 less the edits from a to b by the longer one's length; 0 where one is null, 1 where both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0) + F.length(a) * 0), F.lit(0.0))


def _ranked(rows: DataFrame, order: Column, row_id: str) -> DataFrame:
    """rows with their number in a sorted order; the parts of the sort are counted, so no task sees all rows."""
    path = f"{scratch(rows.sparkSession)}/ranked"
    placed = rows.withColumn("__key", order).where("__key is not null").orderBy("__key", row_id).withColumn("__at", F.monotonically_increasing_id())
    placed.withColumn("__part", F.shiftright("__at", 33)).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    ahead, before = 0, []
    for part, n in placed.groupBy("__part").count().orderBy("__part").collect():  # a row for each part of the sort
        before += [F.lit(part), F.lit(ahead)]
        ahead += n
    start = F.coalesce(F.try_element_at(F.create_map(*before), F.col("__part")), F.lit(0)) if before else F.lit(0)
    return placed.withColumn("__rank", start + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__key")


def alike_pairs(rows: DataFrame, row_id: str, orders: list[Column], score: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], least: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(a, b, score) of rows that stand within neighbours of one another in one of orders and score at least least.

    score takes two functions that give a column of the one and of the other row. Rows whose order is null take no part in it.
    """
    found = None
    for order in orders:
        ranked = _ranked(rows, order, row_id)
        left = ranked.select(F.struct(*rows.columns).alias("x"), F.explode(F.sequence(F.col("__rank") + 1, F.col("__rank") + neighbours)).alias("next"))
        right = ranked.select(F.struct(*rows.columns).alias("y"), F.col("__rank").alias("next"))
        met = left.join(right, "next").withColumn("score", score(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))).where(F.col("score") >= least)
        ids = F.col(f"x.{row_id}"), F.col(f"y.{row_id}")
        pairs = met.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b"), "score")
        found = pairs if found is None else found.union(pairs)
    return found.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"))


def grouped(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) to (node, root): root is the least node that can be reached. Labels jump along their own labels, so rounds grow with the logarithm of a chain."""
    spark, folder = pairs.sparkSession, scratch(pairs.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    edges = kept(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels, n = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels0"), 0
    while True:
        n += 1
        of = labels.withColumnsRenamed({"node": "b", "root": "near"})
        best = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(best, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # the label that a neighbour gives also goes to the node that was the label so far
        handed = lower.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("handed"))
        lower = lower.join(handed, "node", "left").select("node", "was", F.least("root", "handed").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = kept(lower.join(jump, "root", "left").select("node", "was", F.least("root", "far").alias("root")), f"labels{n}")
        labels = moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            return labels
