"""Connected components of an edge table: union-find where edges lie, alternating large and small stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, stored


def spanning_forest(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to edges that connect the same nodes: each partition's own edges through union-find.

    What comes back of a partition is one edge for each of its nodes but the roots, however many edges it held.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if u is not None and v is not None:
                    a, b = root(u), root(v)
                    parent[max(a, b)] = min(a, b)
        nodes = np.fromiter((x for x, up in parent.items() if up != x), np.int64)
        yield pa.record_batch({"u": nodes, "v": np.fromiter(map(root, nodes.tolist()), np.int64, len(nodes))})

    return edges.select("u", "v").mapInArrow(apply, "u long, v long")


def _minimum(edges: DataFrame) -> DataFrame:
    """For each u its least neighbour; combined before the shuffle, so a hub costs one row a task."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("node", F.least("node", "least").alias("least"))
    joined = both.join(least, both.u == least.node)
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = _minimum(edges)
    moved = edges.join(least, edges.u == least.node).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").union(least.select(F.col("node").alias("u"), F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long, any direction, repeats and loops allowed) to (node, root): root is the least id of the component.

    Rows with a null end are no edges. Nodes without an edge to another node don't appear. The result is a stored table. Each round is written to
    the shared folder, so the plan stays short and a lost executor repeats one round at most; rounds grow with the
    logarithm of the longest path.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNull() | F.col("v").isNull())
    current = stored(pairs.toDF("u", "v", "broken").where("not broken and u > v").select("u", "v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(current)
    while was[0]:
        following = stored(_small_star(_large_star(current)), "edges")
        drop_stored(current)
        current, now = following, state(following)
        if now == was:
            break
        was = now
    rooted = current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = stored(rooted, "components")
    drop_stored(current)
    return out
