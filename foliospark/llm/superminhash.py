"""Near-duplicate groups by SuperMinHash signatures of word shingles.

Every shingle seeds a random permutation of the signature's places and a random number for each rank. Rank by rank it
offers (rank + number) to the place that its permutation has there, and a place keeps the least offer. Ranks of one
shingle are correlated over the places, so signatures of small sets vary less than with independent minima. Once every
place of a text is taken no later rank can be less, and the text stops: with many shingles after the first rank.

Texts that share ROWS places of one of BANDS bands are candidates. Two sets at a similarity of 0.85 share no band with
a chance of (1 - 0.85^5)^25, or 4 in 10 million, closer ones with less; what is in one bucket is settled by
jaccard.near_links() without comparing all its pairs, every link is confirmed on the whole sets, and union-find groups what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, narrow_batches, stored, table
from foliospark.llm.components import connected_components, spanning_forest
from foliospark.llm.jaccard import few, near_links, shared_buckets, union_all

BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Shingles of the texts that are worked on together; a text with more is worked on alone.
TOGETHER = 1 << 16

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_OPEN = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one UTF-8 text, A-Z in lower case; fewer words: all of them as one; none: nothing."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * _A + own[i : i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES offers for each nonempty set: the rank in the upper 8 bits, the number in the others."""
    if len(sets) == 1 and len(sets[0]) > TOGETHER:  # offers are kept by minimum, so parts can be joined
        return np.min([signatures([sets[0][i : i + TOGETHER]]) for i in range(0, len(sets[0]), TOGETHER)], axis=0)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * PLACES, _OPEN)
    places = np.tile(np.arange(PLACES, dtype=np.uint8), (len(element), 1))  # each shingle's permutation, shuffled as far as it is read
    for rank in range(PLACES):
        draw = mixed(element + np.uint64((2 * rank + 1) * int(_A) % 2**64))
        at, jump = np.arange(len(element)), rank + ((draw >> np.uint64(32)) % np.uint64(PLACES - rank)).astype(np.int64)
        taken = places[at, jump].astype(np.int64)
        places[at, jump] = places[:, rank]
        np.minimum.at(out, owner * PLACES + taken, (np.uint64(rank) << np.uint64(56)) | (mixed(draw ^ _C) >> np.uint64(8)))
        open_ = (out.reshape(-1, PLACES) == _OPEN).any(axis=1)  # the others are done: a later rank can't be less
        if not open_.any():
            break
        still = open_[owner]
        if not still.all():
            element, owner, places = element[still], owner[still], places[still]
    return out.reshape(-1, PLACES)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Bucket of each band of each row, as signed longs."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        key = mixed(key * _A + rows[:, :, i])
    return key.view(np.int64)


def key_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, text) to doc_id, key and size of the shingle set, and its buckets; a set without shingles has none and a null key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, buckets, held = [], [], [], []

            def flush(held=held, buckets=buckets) -> None:
                if held:
                    buckets.extend(bands_of(signatures(held)).tolist())
                    held.clear()

            for text in batch.column("text").to_pylist():
                own = shingles_of(text, shingle)
                sizes.append(len(own))
                if not len(own):
                    flush()
                    keys.append(None)
                    buckets.append([])
                    continue
                keys.append(key_of(own))
                if held and sum(map(len, held)) + len(own) > TOGETHER:
                    flush()
                held.append(own)
            flush()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.int64()), "size": pa.array(sizes, pa.int64()), "buckets": pa.array(buckets, pa.list_(pa.int64()))})

    whole = narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(rows, "doc_id long, key long, size long, buckets array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (text) to key and hashes, the shingle set as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(x, shingle) for x in batch.column("text").to_pylist()]
            yield pa.record_batch({"key": pa.array([key_of(s) for s in sets], pa.int64()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})

    return narrow_batches(texts).select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, "key long, hashes binary")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, kept; one row per input row, a stored table.

    A document's set are its distinct word shingles (fewer words: all of them as one). Documents are linked where
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, and kept says whether that is
    the row's own. Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null doc_id
    are linked like any other and never kept; a component of such rows alone has a null component_id. Repeated rows stay repeated;
    other columns, whatever their names, are left out; an empty table gives an empty one. Sets are whatever their text's length gives.

    Equal sets are one node from the start, so a group of copies is one row in all joins.
    """
    rows = stored(sketches(docs, shingle), "sketches")
    nodes = stored(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("buckets").alias("buckets")), "nodes")
    members = shared_buckets(nodes)
    wanted = stored(members.select("key").distinct().join(nodes.select("key", "id"), "key"), "wanted")
    ids = stored(wanted.where("id is not null").select("id").distinct(), "ids")
    named = docs.join(few(ids), F.col("doc_id") == F.col("id")).select("text")
    sets = shingle_sets(named.union(docs.where("doc_id is null").select("text")), shingle)
    sets = stored(sets.join(wanted.select("key"), "key").groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
    links = near_links(members, sets, percent, [])
    linked = spanning_forest(union_all(links)) if links else nodes.where("false").select(F.col("key").alias("u"), F.col("key").alias("v"))
    roots = connected_components(linked)
    joined = nodes.join(roots, nodes.key == roots.node, "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(joined.join(least, "root").select("key", "component_id"), "named")
    drop_stored(nodes, members, wanted, ids, sets, roots, *links)
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    met = rows.join(named.withColumnRenamed("key", "own"), F.col("key") == F.col("own"), "left")
    out = stored(met.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near")
    drop_stored(rows, named)
    return out


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """docs without near copies, all columns kept: the rows whose doc_id is their group's smallest, of rows with one doc_id the one with the least text."""
    keep = near_groups(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("keep")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    best = rows.join(keep, F.col("own_id") == F.col("keep")).withColumn("n", F.expr("row_number() over (partition by own_id order by own_text)"))
    return best.where("n = 1").select("row.*")


def op12_superminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: Links of distinct sets by common shingles; components by the least id reachable.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
sets AS (SELECT s, min(doc_id) AS id, len(s) AS size FROM shingled WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT id, size, unnest(s) AS x FROM sets),
links AS (
  SELECT a.id AS u, b.id AS v FROM parts a JOIN parts b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.size, b.size
  HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
reach AS (SELECT id AS u, id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM shingled d LEFT JOIN sets USING (s) LEFT JOIN least ON id = u
"""
