"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted onto a sphere (one more component makes all norms equal), where the largest inner products are the
smallest distances. The index keys every vector by its nearest pivot and its distance from it. A query skips the cells
whose whole range of distances lies, by the triangle inequality, beyond the radius that its k best scores so far allow;
within a cell it takes annuli from the nearest on and stops at the first that lies beyond.

Bounds are floating-point numbers with room for rounding; scores are whole numbers from beginning to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, stored

#: Pivots grow with the square root of the vectors, up to this many; vectors of the sample that they and the first thresholds come from.
PIVOTS, SAMPLE = 4096, 4096
#: Vectors of an index block, queries of a query block, vectors of an annulus.
BLOCK, QUERIES, ANNULUS = 4096, 2048, 256
#: Below this squared norm floats hold every sum of products exactly; beyond it scores are worked out in 64-bit integers.
FLOAT_EXACT, LONG_EXACT = 2.0**53 * (1 - 1e-9), 2.0**63 * (1 - 1e-9)

#: Stands for no score yet; no score is as low.
_NONE = -np.iinfo(np.int64).max


def whole_vector(embedding: Column) -> Column:
    """floor(256 * x) of each component; null where the vector or a component is null or not finite."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = np.zeros((len(vectors), width), np.int64)
    offsets = vectors.offsets.to_numpy()
    out[np.arange(width) < np.diff(offsets)[:, None]] = vectors.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


class Lift:
    """Distances on the sphere of radius r around the origin, one dimension up."""

    def __init__(self, pivots: np.ndarray, r2: float) -> None:
        self.r2 = r2
        self.pivots = self.up(pivots.astype(float))

    def up(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.r2 - (x * x).sum(1), 0))]

    def stretch(self, q: np.ndarray) -> np.ndarray:
        """Factor that brings a query onto the sphere (its order of scores stays); 1 for the zero vector."""
        norm = np.sqrt((q * q).sum(1))
        return np.where(norm > 0, np.sqrt(self.r2) / np.where(norm > 0, norm, 1), 1.0)

    def to_pivots(self, up: np.ndarray, pivots: slice = slice(None)) -> np.ndarray:
        own = self.pivots[pivots]
        d2 = (up * up).sum(1)[:, None] + (own**2).sum(1)[None, :] - 2 * up @ own.T
        return np.sqrt(np.maximum(d2, 0))

    def of_queries(self, q: np.ndarray, pivots: slice = slice(None)) -> np.ndarray:
        """Distances of queries, brought onto the sphere, to the pivots."""
        return self.to_pivots(self.up(q * self.stretch(q)[:, None] * (1 - 1e-12)), pivots)

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance within which all vectors of at least this score lie, with room for rounding; without a score yet: no bound."""
        s = self.stretch(q)
        d2 = s * s * (q * q).sum(1) + self.r2 - 2 * s * score.astype(float)
        return np.where(score == _NONE, np.inf, np.sqrt(np.maximum(d2, 0)) + 1e-6 * np.sqrt(self.r2) + 1e-6)


def scores_of(q: np.ndarray, x: np.ndarray, r2: float) -> np.ndarray:
    """Inner products as whole numbers. No sum of some products exceeds r2, so floats are exact below FLOAT_EXACT."""
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if r2 < FLOAT_EXACT else q @ x.T


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to smaller ids."""
    if len(score) > k:
        place = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        place = np.arange(len(score))
    return place[np.lexsort((ids[place], -score[place]))][:k]


def search(lift: Lift, pivot: int, block: pa.Table, queries: pa.Table, k: int, width: int) -> pa.Table:
    """k best vectors of one index block for each query, those that a better bound rules out left aside."""
    block = block.sort_by([("distance", "ascending"), ("gid", "ascending")])
    x, ids, far = matrix(block["vec"], width), block["gid"].to_numpy(), block["distance"].to_numpy()
    q = matrix(queries["vec"], width)
    flat = q.astype(float)
    own = lift.of_queries(flat, slice(pivot, pivot + 1))[:, 0]
    limit = queries["threshold"].to_numpy().copy()
    top_score = np.full((len(q), k), _NONE)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    edges = [(i, min(i + ANNULUS, len(x))) for i in range(0, len(x), ANNULUS)]
    low, high = np.array([far[a] for a, _ in edges]), np.array([far[b - 1] for _, b in edges])
    bound = np.maximum(0, np.maximum(low[None, :] - own[:, None], own[:, None] - high[None, :]))
    for n in np.argsort(bound.min(axis=0), kind="stable"):
        open_ = np.flatnonzero(bound[:, n] <= lift.radius(flat, limit))
        if not len(open_):
            continue
        part = slice(*edges[n])
        score = scores_of(q[open_], x[part], lift.r2)
        for i, row in zip(open_.tolist(), score, strict=True):
            if row.max() < limit[i]:
                continue
            both, who = np.r_[top_score[i], row], np.r_[top_id[i], ids[part]]
            keep = best_of(both, who, k)
            top_score[i], top_id[i] = both[keep], who[keep]
            limit[i] = max(limit[i], top_score[i, -1])
    query, nth = np.nonzero(top_score != _NONE)
    return pa.table({"query_gid": queries["gid"].to_numpy()[query], "gid": top_id[query, nth], "score": top_score[query, nth]})


def query_blocks(pivots: np.ndarray, asked: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each cell the first block of its queries and how many there are.

    asked: queries of each cell. Cells are taken in order of their pivots' place on the main axis, so that queries of
    one block lie near one another and open the same cells; a cell with more queries than a block has several.
    """
    centred = pivots - pivots.mean(axis=0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(len(pivots))
    out, block, held = {}, 0, 0
    for cell in sorted(asked, key=lambda c: (along[c], c)):
        n = asked[cell]
        if held and held + n > QUERIES:
            block, held = block + 1, 0
        parts = -(-n // QUERIES)
        out[cell] = block, parts
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors (vec_id, embedding) to query_id, rank, vec_id, score: the k rows of the highest score for each row that is_query holds for.

    A query's own row is no candidate; with fewer than k other rows all come; ties go to the smaller vec_id. Rows whose
    vec_id or vector is null, or that hold null or non-finite components, take no part; equal rows count once; shorter
    vectors are filled up with zeros; other columns are left out; an empty table gives an empty one. vec_id otherwise
    names one vector. Scores are exact; vectors whose squared norm (after the scaling by 256) reaches 2^63 raise, since
    their scores are no 64-bit numbers.

    Equal vectors are one entry of the index with their k + 1 smallest ids, which is all that any result can need, so
    a vector that a third of the rows share costs no more than another. An index block goes to those query blocks only
    that open its cell.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding")).alias("vec"), is_query.alias("asks")).where("vec_id is not null and vec is not null")
    rows = rows.distinct()
    ranked = rows.withColumn("n", F.expr("row_number() over (partition by vec order by vec_id)")).where(F.col("n") <= k + 1)
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    entries = stored(ranked.groupBy("vec").agg(F.min("vec_id").alias("gid"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("norm2", squares), "entries")
    r2, width, n_entries = entries.agg(F.max("norm2"), F.max(F.size("vec")), F.count("*")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if r2 is None:
        return spark.createDataFrame([], schema)
    if r2 >= LONG_EXACT:
        raise ValueError("a vector's squared norm reaches 2^63; its scores are no 64-bit numbers")
    drawn = entries.orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("vec").toArrow()
    sample = matrix(drawn["vec"], width)
    lift = Lift(sample[: max(16, min(PIVOTS, int(n_entries**0.5)))], r2)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = lift.to_pivots(lift.up(matrix(batch.column("vec"), width).astype(float)))
            near = d.argmin(axis=1)
            yield pa.record_batch({"gid": batch.column("gid"), "vec": batch.column("vec"), "cell": near.astype(np.int32), "distance": d[np.arange(len(d)), near]})

    keys = stored(entries.select("gid", "vec").mapInArrow(keyed, "gid long, vec array<long>, cell int, distance double"), "index")
    cells = {r["cell"]: r for r in keys.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c, r in cells.items() for x in (c, -(-r["n"] // BLOCK))]), F.col("cell"))
    index = keys.withColumn("block", F.pmod(F.xxhash64("gid"), n_blocks.cast("long")).cast("int"))
    # the entry that a query's row belongs to: its vector's
    asking = stored(rows.where("asks").join(entries.select("vec", "gid"), "vec").select(F.col("vec_id").alias("query_id"), "gid"), "asking")
    heard = index.join(asking.select("gid").distinct(), "gid", "left_semi")
    asked = {r["cell"]: r["n"] for r in heard.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], schema)
    places = query_blocks(lift.pivots, asked)
    first, parts = [F.element_at(F.create_map(*[F.lit(x) for c, p in places.items() for x in (c, p[i])]), F.col("cell")) for i in (0, 1)]
    heard = heard.select("gid", "vec", (first + F.pmod(F.xxhash64("gid", F.lit(1)), parts.cast("long"))).cast("int").alias("query_block"))
    names = np.array(sorted(cells))
    low, high = np.array([cells[c]["low"] for c in names.tolist()]), np.array([cells[c]["high"] for c in names.tolist()])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells that each query has to look into."""
        for batch in batches:
            q = matrix(batch.column("vec"), width)
            score = scores_of(q, sample, r2)
            threshold = np.partition(score, score.shape[1] - k - 1, axis=1)[:, score.shape[1] - k - 1] if score.shape[1] > k else np.full(len(q), _NONE)
            own = lift.of_queries(q.astype(float))[:, names]
            bound = np.maximum(0, np.maximum(low - own, own - high))
            row, col = np.nonzero(bound <= lift.radius(q.astype(float), threshold)[:, None])
            taken = batch.take(pa.array(row))
            yield pa.record_batch({"gid": taken.column("gid"), "vec": taken.column("vec"), "query_block": taken.column("query_block"), "threshold": threshold[row], "cell": names[col].astype(np.int32)})

    looks = stored(heard.mapInArrow(opened, "gid long, vec array<long>, query_block int, threshold long, cell int"), "looks")
    met_blocks = looks.select("cell", "query_block").distinct().select("cell", F.col("query_block").alias("asking_block"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    spread = index.join(met_blocks, ["cell", "block"]).select("gid", "vec", "distance", "cell", "block", "asking_block")
    queries = looks.select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))

    def met(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block):  # no vector fell into this block
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_gid", "gid", "score")})
        return search(lift, key[0].as_py(), block, asked, k + 1, width)

    found = spread.groupBy("cell", "block", "asking_block").cogroup(queries.groupBy("cell", "block", "query_block")).applyInArrow(met, "query_gid long, gid long, score long")
    near = found.withColumn("n", F.expr("row_number() over (partition by query_gid order by score desc, gid)")).where(F.col("n") <= k + 1)
    listed = near.join(entries.select("gid", "ids"), "gid").select("query_gid", "score", F.explode("ids").alias("vec_id"))
    paired = asking.join(listed, asking.gid == listed.query_gid).where("query_id <> vec_id")
    ranked = paired.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    out = stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best")
    drop_stored(entries, keys, asking, looks)
    return out


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
