"""Near-duplicate groups by exact Jaccard similarity of word shingles, for the near-dedup stage.

Candidates come from the SimHash operator's covering tables first: texts within its radius. At a Jaccard similarity of
0.8 fingerprints differ in some 10 of 64 bits, beyond any covering tables, so those pairs are met by bands of minima of
the shingle hashes: a pair that shares ROWS minima in one of BANDS bands is a candidate, which leaves out a pair at
exactly 0.8 with a chance of (1 - 0.8^5)^25, or 0.005 %, and a closer one with less. Every link is then confirmed on
the whole shingle sets.

Equal shingle sets are one node from the start. A bucket is compared in rounds with one of its nodes, so a group of near
copies costs one comparison a copy. Nodes that this leaves in different components meet by the rarest of their shingles: alike
sets must have one of a few in common, and what is near without being alike differs in just those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import simhash
from foliospark.llm.common import drop_stored, narrow_batches, stored
from foliospark.llm.components import connected_components, spanning_forest

BANDS, ROWS = 25, 5
#: Rounds in which a bucket is compared with one node. Shingles of the sample that common ones are counted in, and how many of those are kept.
ROUNDS, SAMPLE, COMMON = 2, 2_000_000, 1 << 18
#: Shingles that are permuted at once; bytes of texts or sets that go to a Python worker at once.
CHUNK, BATCH = 4096, 8 << 20

_SEEDS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one UTF-8 text; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def bands_of(hashes: np.ndarray) -> list[int]:
    """Bucket of each band, as signed longs; no shingles: no buckets."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        mixed = (hashes[i : i + CHUNK, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * _MIX).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def key_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def sketch(text: Column, shingle: int = 5) -> Column:
    """Struct of the key and the size of a text's shingle set, its SimHash and its buckets."""

    @F.pandas_udf("key long, size int, print long, buckets array<long>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles_of(x, shingle) for x in texts]
            prints = np.fromiter((simhash.fingerprint_of(x, shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield pd.DataFrame({"key": [key_of(s) for s in sets], "size": [len(s) for s in sets], "print": prints, "buckets": [bands_of(s) for s in sets]})
            pa.default_memory_pool().release_unused()

    return apply(text.cast("binary"))


def shingle_set(text: Column, shingle: int = 5) -> Column:
    """Struct of the key of a text's shingle set and the set, as bytes."""

    @F.pandas_udf("key long, hashes binary")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles_of(x, shingle) for x in texts]
            yield pd.DataFrame({"key": [key_of(s) for s in sets], "hashes": [s.tobytes() for s in sets]})
            pa.default_memory_pool().release_unused()

    return apply(text.cast("binary"))


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether two shingle sets, as bytes, have a Jaccard similarity of at least percent / 100, compared as whole numbers."""

    def one(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    @F.pandas_udf("boolean")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype=bool)
            pa.default_memory_pool().release_unused()

    return apply(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike, as a stored table."""
    left, right = sets.select(F.col("key").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("key").alias("v"), F.col("hashes").alias("b"))
    met = narrow_batches(pairs.join(left, "u").join(right, "v"))
    return stored(met.where(alike(F.col("a"), F.col("b"), percent)).select("u", "v"), "links")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (key, print) to pairs (u, v) of keys: they connect what the SimHash operator links."""
    prints = stored(nodes.groupBy("print").agg(F.min("key").alias("id")), "prints")
    same = nodes.join(prints, "print").where("key <> id").select(F.col("id").alias("u"), F.col("key").alias("v"))
    near = simhash.near_links(prints)
    pairs = stored(near.union(same).distinct(), "pairs")
    drop_stored(prints, near)
    return pairs


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """nodes (key, size, buckets) to members (bucket, key, size, degree) of the buckets that several nodes share, a stored table.

    degree is the number of nodes that a node meets, those of each bucket counted. What near copies were made from meets
    more of them than they meet of one another.
    """
    members = nodes.select("key", "size", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(members.join(shared, "bucket").select("bucket", "key", "size", "n"), "met")
    out = stored(met.drop("n").join(met.groupBy("key").agg(F.sum("n").alias("degree")), "key"), "members")
    drop_stored(met)
    return out


def _open(members: DataFrame, *more: Column) -> DataFrame:
    """Each bucket that holds nodes of different components, with what more aggregates of it."""
    return members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *more).where("low <> high").drop("low", "high")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that come often in sets (key, hashes), sorted, and how often.

    Counted in a sample of sets of SAMPLE shingles together, chosen by a hash of the key; COMMON of them at most. They only
    make an order, which finds the same pairs whatever it is, in less time the rarer the shingles are that it begins with.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"hash": np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)})

    total = sets.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    parts = max(1, round(total / SAMPLE))
    rows = sets.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(parts)) == 0).select("hashes").mapInArrow(each, "hash long")
    often = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, n = often["hash"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefixes(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """nodes (key, root, hashes) to bucket, key, root, size, place: the first shingles of each set, rare ones first.

    Sets of a similarity of percent / 100 or more have one of those in common, since fewer shingles are left than they share. place counts from 1.
    """
    known, often = common

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes = [], []
            for raw in batch.column("hashes").to_pylist():
                own = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                n = np.where(known[at] == own, often[at], 0) if len(known) else np.zeros(len(own), np.int64)
                first.append(own[np.lexsort((own, n))[: len(own) - -(-percent * len(own) // 100) + 1]])
                sizes.append(len(own))
            lengths = [len(x) for x in first]
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.concatenate([np.arange(1, n + 1) for n in lengths]) if lengths else np.empty(0, np.int64)
            bucket = np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64)
            keys, roots = (batch.column(c).take(pa.array(row, pa.int64())) for c in ("key", "root"))
            yield pa.record_batch({"bucket": bucket, "key": keys, "root": roots, "size": np.repeat(np.array(sizes, np.int64), lengths), "place": place})

    return narrow_batches(nodes).select("key", "root", "hashes").mapInArrow(each, "bucket long, key long, root long, size long, place long")


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (see prefixes) of different components that share a bucket and, from there on, enough shingles."""
    left = members.select("bucket", F.col("key").alias("u"), "root", "size", "place")
    right = members.select("bucket", F.col("key").alias("v"), F.col("root").alias("other_root"), F.col("size").alias("other"), F.col("place").alias("other_place"))
    most = 1 + F.least(F.col("size") - F.col("place"), F.col("other") - F.col("other_place"))
    close = (100 + percent) * most >= percent * (F.col("size") + F.col("other"))
    return left.join(right, "bucket").where("u < v and root <> other_root").where(_sizes_allow("size", "other", percent) & close).select("u", "v").distinct()


def near_links(members: DataFrame, sets: DataFrame, percent: int, links: list[DataFrame]) -> list[DataFrame]:
    """members (see shared_buckets), sets (key, hashes) and the links known so far to stored tables of links (u, v): with those they connect what alike pairs within buckets connect.

    In each of ROUNDS rounds every bucket is compared with one of its nodes, the one that meets most others, so a group of
    near copies costs one comparison a copy. Nodes of buckets that then still hold several components are mostly near
    one another without being alike. Those are compared only where they share one of the rare shingles that alike sets must share.
    """
    links = list(links)
    open_ = members.withColumn("root", F.col("key"))
    reads: list[DataFrame] = []  # stored tables that open_ reads
    for turn in range(ROUNDS + 1):
        if links:
            roots = connected_components(spanning_forest(union_all(links)))
            met = open_.drop("root").join(roots, open_.key == roots.node, "left")
            open_ = met.select("bucket", "key", "size", "degree", F.coalesce("root", "key").alias("root"))
            reads.append(roots)
        last = turn == ROUNDS
        centre = F.max_by(F.struct("key", "size", "root"), F.struct("degree", F.xxhash64("key", F.lit(turn)))).alias("c")
        still = stored(open_.join(_open(open_, *([] if last else [centre])), "bucket"), "open")
        drop_stored(*reads)
        open_, reads = still, [still]
        if open_.isEmpty():
            break
        if last:
            nodes = stored(open_.select("key", "root").distinct().join(sets, "key"), "nodes")
            first = stored(prefixes(nodes, common_shingles(nodes), percent), "first")
            reads += [nodes, first]
            pairs = prefix_pairs(first, percent)
        else:
            pairs = open_.where("root <> c.root").select(F.least("key", "c.key").alias("u"), F.greatest("key", "c.key").alias("v"), "size", F.col("c.size").alias("other"))
            pairs = pairs.where(_sizes_allow("size", "other", percent)).select("u", "v").distinct()
        links.append(confirmed(pairs, sets, percent))
        if not last:  # the node compared with all others of its bucket is done with
            open_ = open_.where("key <> c.key").drop("c")
    drop_stored(*reads)
    return links


#: Rows of a table that is sent to all tasks; with more it is joined by sorting.
SENT = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """A stored table of one long column, marked to be sent to all tasks where it has SENT rows at most, some 16 MB."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def union_all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.union(more)
    return whole


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) to one row per input row: doc_id, key, root; a stored table.

    Rows of one root are connected by pairs with a Jaccard similarity of at least percent / 100. Null, empty and blank texts
    are one group; rows with a null doc_id are linked like any other; other columns are left out; texts are read whole,
    however long, and a set of shingles has to fit into a row.
    """
    rows = stored(narrow_batches(docs, size=BATCH).select("doc_id", sketch(F.col("text"), shingle).alias("s")).select("doc_id", "s.*"), "sketches")
    nodes = stored(rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.min("print").alias("print"), F.first("buckets").alias("buckets")), "nodes")
    members = shared_buckets(nodes)
    close = simhash_pairs(nodes.select("key", "print"))
    met = members.select("key").union(close.select("u")).union(close.select("v")).distinct()
    wanted = stored(met.join(nodes.select("key", "id"), "key"), "wanted")
    ids = stored(wanted.where("id is not null").select("id").distinct(), "ids")
    named = docs.join(few(ids), F.col("doc_id") == F.col("id")).select("text")
    texts = named.union(docs.where("doc_id is null").select("text"))
    sets = narrow_batches(texts).select(shingle_set(F.col("text"), shingle).alias("s")).select("s.*")
    sets = stored(sets.join(wanted.select("key"), "key").groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
    links = near_links(members, sets, percent, [confirmed(close, sets, percent)])
    roots = connected_components(spanning_forest(union_all(links)))
    out = stored(rows.join(roots, rows.key == roots.node, "left").select("doc_id", "key", F.coalesce("root", "key").alias("root")), "groups")
    drop_stored(rows, nodes, members, wanted, ids, close, sets, roots, *links)
    return out


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies, all columns kept: of each group the row with the smallest doc_id stays.

    Of rows that share that doc_id the one with the least text stays. Rows with a null doc_id stay only if nothing in
    their group has an id, one for each group.
    """
    groups = near_groups(docs, shingle, percent)
    firsts = stored(groups.groupBy("root").agg(F.min("doc_id").alias("keep")), "firsts")
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    keep = firsts.where("keep is not null").select("keep").distinct()
    # ids whose rows go, and ids that several rows have: few beside the rows, whose texts stay where they are
    gone = stored(ids.join(keep, ids.doc_id == keep.keep, "left_anti").select(F.col("doc_id").alias("gone")), "gone")
    several = stored(ids.where("n > 1").join(keep, F.col("doc_id") == F.col("keep")).select(F.col("doc_id").alias("again")), "several")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    single = rows.where("own_id is not null").join(few(gone), F.col("own_id") == F.col("gone"), "left_anti").join(few(several), F.col("own_id") == F.col("again"), "left_anti")
    best = rows.join(few(several), F.col("own_id") == F.col("again")).withColumn("n", F.expr("row_number() over (partition by own_id order by own_text)"))
    lone = groups.where("doc_id is null").join(firsts.where("keep is null"), "root").select("key", "root").distinct()
    unnamed = narrow_batches(rows.where("own_id is null")).withColumn("own_key", shingle_set(F.col("own_text"), shingle)["key"])
    unnamed = unnamed.join(lone, F.col("own_key") == F.col("key")).withColumn("n", F.expr("row_number() over (partition by root order by own_text)"))
    return single.select("row").union(best.where("n = 1").select("row")).union(unnamed.where("n = 1").select("row")).select("row.*")
