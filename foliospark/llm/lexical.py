"""Ranked lexical search by hashed max-sketches.

A document's terms hash to the coordinates of a sketch, a power of two of them, some four for each distinct term; a
coordinate holds the greatest frequency of the terms that fell on it. A term's impact grows with its frequency, so the
impact at that coordinate's frequency bounds the impact of every such term from above, and the sum over a query's terms
bounds the document's score. Sketches hold no statistics of the corpus: weights and lengths come in when they are read,
so a document added later changes no other sketch.

Queries come in batches. A task reads its part of the index in blocks, looks the whole batch up in a block's sketches
at once, and rescores documents exactly in descending order of their bounds until a bound falls below the query's k-th
best score so far, which goes on to the next block. Exact scores of a part of the index give the first thresholds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, narrow_batches, stored, table

#: A term is a stretch of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Coordinates of a sketch for each distinct term, at least; the greatest frequency that a coordinate tells from more.
WIDTH, MOST = 4, 255
#: Documents whose sketches are looked up at once; documents rescored before a query's threshold is looked at again.
BLOCK, CHUNK = 512, 16
#: Terms of a batch of queries, on average; the first thresholds come from one document in FIRST.
BATCH_TERMS, FIRST = 100_000, 32

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of one UTF-8 text, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def sketch_of(terms: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Coordinatewise maxima of the terms' frequencies; MOST stands for itself and all above."""
    width = 1 << max(3, (WIDTH * len(terms) - 1).bit_length())
    at = np.fromiter(map(crc32, terms), np.int64, len(terms)) & (width - 1)
    out = np.zeros(width, np.uint8)
    np.maximum.at(out, at, np.minimum(counts, MOST).astype(np.uint8))
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to the index, a row for each document with a term: doc_id, n (terms, repeats included), terms, counts, sketch.

    terms are joined by blanks, counts are 32-bit numbers in their order. Documents without terms (null and empty texts)
    have no row; repeated rows stay repeated; other columns are left out. Texts are read whole, however long.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, terms, counts, sketches = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                own = Counter(found)
                words, often = list(own), np.fromiter(own.values(), np.int32, len(own))
                kept.append(i)
                n.append(len(found))
                terms.append(b" ".join(words))
                counts.append(often.tobytes())
                sketches.append(sketch_of(words, often).tobytes())
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(kept, pa.int64())), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.binary()), "counts": pa.array(counts, pa.binary()), "sketch": pa.array(sketches, pa.binary())})

    whole = narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(rows, "doc_id long, n long, terms binary, counts binary, sketch binary")


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) to item_id, terms: the distinct terms of all its rows, in order. Items without terms have no row."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = items.where("item_id is not null").select("item_id", F.explode(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def weight_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))), never below 0 since no term is in more than N documents."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def saturated(counts: np.ndarray, m: int) -> np.ndarray:
    """(10^9 * tf) div (1000 * tf + 20 * m); it grows with tf and stays below 10^6."""
    tf = counts.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Batch:
    """Queries of one pass: their ids, and each one's terms as places in the batch's vocabulary."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [[self.vocabulary.setdefault(t.encode(), len(self.vocabulary)) for t in terms] for _, terms in rows]
        self.flat = np.concatenate([np.array(t, np.int64) for t in self.terms])
        self.starts = np.cumsum([0, *map(len, self.terms[:-1])])
        self.hashes = np.fromiter(map(crc32, self.vocabulary), np.int64, len(self.vocabulary))


def document_frequencies(index: DataFrame, batch: Batch) -> dict[bytes, int]:
    """For each term of a batch the number of documents that hold it."""
    vocabulary = batch.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for rows in batches:
            for terms in rows.column("terms").to_pylist():
                found.update(filter(vocabulary.__contains__, terms.split()))
        yield pa.record_batch({"term": pa.array(found.keys(), pa.binary()), "n": pa.array(found.values(), pa.int64())})

    counted = index.select("terms").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in counted.collect()}  # one row for each term of the batch at most


class Best:
    """The k highest scores of each query so far, ties to smaller ids, and the score below which nothing counts."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.ids, self.scores = [np.empty(0, np.int64) for _ in least], [np.empty(0, np.int64) for _ in least]

    def add(self, q: int, ids: list[int], scores: list[int]) -> None:
        ids, scores = np.r_[self.ids[q], np.array(ids, np.int64)], np.r_[self.scores[q], np.array(scores, np.int64)]
        ids, scores = ids[scores >= self.least[q]], scores[scores >= self.least[q]]
        keep = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[keep], scores[keep]
        if len(keep) == self.k:
            self.least[q] = max(self.least[q], self.scores[q][-1])


def _searched(batch: Batch, weights: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray, k: int):
    """Over index rows: each task's k best documents of each query, none below least."""

    def bounds(sketches: list[bytes], m: np.ndarray) -> np.ndarray:
        out = np.empty((len(sketches), len(batch.ids)), np.int64)
        levels = np.arange(MOST + 1)
        for i, raw in enumerate(sketches):
            sketch = np.frombuffer(raw, np.uint8)
            impact = saturated(levels, m[i])
            impact[MOST] = 1_000_000
            looked_up = impact[sketch[batch.hashes & (len(sketch) - 1)]] * weights
            out[i] = np.add.reduceat(looked_up[batch.flat], batch.starts)
        return out

    def impacts(terms: bytes, counts: bytes, m: int) -> dict[int, int]:
        """Of the batch's terms that the document holds."""
        places = [batch.vocabulary.get(t) for t in terms.split()]
        held = np.array([i for i, p in enumerate(places) if p is not None], np.int64)
        own = np.array([places[i] for i in held.tolist()], np.int64)
        return dict(zip(own.tolist(), (weights[own] * saturated(np.frombuffer(counts, np.int32)[held], m)).tolist(), strict=True))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, np.maximum(least, 1))
        for whole in batches:
            for first in range(0, len(whole), BLOCK):
                rows = whole.slice(first, BLOCK)
                ids, n, terms, counts = (rows.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts"))
                m = np.array([50 + 50 * x * n_docs // n_terms for x in n], np.int64)
                bound = bounds(rows.column("sketch").to_pylist(), m)
                known: dict[int, dict[int, int]] = {}
                for q in np.flatnonzero((bound >= best.least).any(axis=0)).tolist():
                    open_ = np.flatnonzero(bound[:, q] >= best.least[q])
                    open_ = open_[np.argsort(-bound[open_, q], kind="stable")]
                    for at in range(0, len(open_), CHUNK):
                        part = open_[at : at + CHUNK]
                        part = part[bound[part, q] >= best.least[q]]
                        if not len(part):
                            break
                        scores = []
                        for d in part.tolist():
                            own = known.get(d)
                            if own is None:
                                own = known[d] = impacts(terms[d], counts[d], int(m[d]))
                            scores.append(sum(own[t] for t in batch.terms[q] if t in own))
                        best.add(q, [ids[d] for d in part.tolist()], scores)
        lengths = [len(x) for x in best.ids]
        yield pa.record_batch({"item_id": np.repeat(batch.ids, lengths), "doc_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})

    return apply


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by item_id order by score desc, doc_id)"))
    return ranked.where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """An index (see build_index; a stored table is read four times a batch) and items (item_id, text) to item_id, rank, doc_id, score.

    The k documents of the highest score above 0 for each item, fewer where there are fewer, equal scores by ascending
    doc_id. A term's weight is weight_of() its document frequency; a document's score is the sum over the item's distinct
    terms of weight times saturated(tf, m), with m = 50 + (50 * n * N) div L for its n terms, N documents and L terms in
    all. Rows with a null doc_id count in these statistics but aren't listed; repeated rows are documents of their own;
    rows of one item_id are one item; null ids of items and items without terms have no rows; an empty index gives none.

    Items go in batches of a bounded number of terms, chosen by a hash of their ids; the driver holds one batch, its
    thresholds and its frequencies at a time. The result is a stored table.
    """
    spark = index.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    asked = stored(item_terms(items).withColumn("item_id", F.col("item_id").cast("long")), "items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0]
    if not n_docs or not size:
        return spark.createDataFrame([], schema)
    parts, found = -(-size // BATCH_TERMS), []
    listed = index.where("doc_id is not null")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        if not rows:
            continue
        batch = Batch([(r["item_id"], r["terms"]) for r in rows])
        often = document_frequencies(index, batch)
        weights = weight_of(n_docs, np.array([often.get(t, 0) for t in batch.vocabulary], np.int64))
        out = "item_id long, doc_id long, score long"
        columns = ["doc_id", "n", "terms", "counts", "sketch"]
        some = listed.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FIRST)) == 0).select(*columns)
        first = _ranked(some.mapInArrow(_searched(batch, weights, n_docs, n_terms, np.zeros(len(batch.ids), np.int64), k), out), k)
        known = {r["item_id"]: r["score"] for r in first.where(F.col("rank") == k).collect()}
        least = np.array([known.get(i, 0) for i in batch.ids.tolist()], np.int64)
        found.append(stored(_ranked(listed.select(*columns).mapInArrow(_searched(batch, weights, n_docs, n_terms, least, k), out), k), "found"))
    drop_stored(asked)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = stored(build_index(table(spark, sf_dir, "documents")), "lexical")
    best = search(index, table(spark, sf_dir, "benchmark"))
    drop_stored(index)
    return best


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
lengths AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM sized, totals WHERE doc_id IS NOT NULL),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
