"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A text becomes a 64-bit fingerprint. Every bit position gets a vector of radius + 1 bits; each nonzero vector v of that
length is a table whose mask holds the positions whose vector has an odd product with v. The positions in which two
fingerprints within the radius differ span fewer than radius + 1 dimensions, so some v is orthogonal to all of them and
the two agree under its mask: no pair is missed, unlike with random bit samples.

Equal fingerprints are one node from the start. The nodes of a bucket are compared in blocks of bounded size and leave
at most a spanning forest, never all pairs; buckets beyond one block are compared block against block in tasks of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, narrow_batches, stored
from foliospark.llm.components import connected_components

#: Nodes of one bucket that a task compares at once.
BLOCK = 512
#: Runs up to this length are compared by shifting, longer ones as a matrix.
SHORT = 8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned fingerprint of one UTF-8 text; null or without words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    of_byte = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.uint16)
    ones = np.einsum("pv,vb->pb", np.bincount(of_byte.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """Fingerprint as a signed long; the whole text counts, repeats of shingles included."""

    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint_of(x, shingle) for x in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return apply(text.cast("binary"))


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed longs."""
    vectors = np.random.default_rng(seed).permutation(np.resize(np.arange(1, 2 ** (radius + 1)), bits))
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        odd = [i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2]
        value = sum(1 << i for i in odd)
        masks.append(value - (1 << 64) if value >> 63 else value)
    return masks


def _forest(ids: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among up to two blocks of nodes."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label, front = np.arange(len(ids)), None
    while front is None or not np.array_equal(front, label):
        front = label
        label = np.where(near, label[None, :], len(ids)).min(axis=1)
        label = label[label]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


_FOUND = "u long, v long, bucket long, slot int, print long, block int"


def _linked(radius: int):
    """Over rows sorted by (slot, bucket, print): links within each bucket; buckets over one block come out as they are, numbered."""

    def rows(u, v, bucket=None, slot=None, prints=None, block=None) -> pa.RecordBatch:
        none = [None] * len(u)
        columns = [u, v, none if bucket is None else bucket, none if slot is None else slot, none if prints is None else prints, none if block is None else block]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["u", "v", "bucket", "slot", "print", "block"])

    def closed(ids, prints, buckets, slots) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        starts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (slots[1:] != slots[:-1])])
        lengths = np.diff(np.r_[starts, len(ids)])
        run = np.repeat(np.arange(len(starts)), lengths)
        short = lengths <= SHORT
        us, vs = [], []
        for lag in range(1, SHORT):
            a = np.flatnonzero((run[lag:] == run[:-lag]) & short[run[lag:]]) if len(run) > lag else np.empty(0, np.int64)
            near = np.bitwise_count(prints[a] ^ prints[a + lag]) <= radius
            us.append(ids[a[near]])
            vs.append(ids[a[near] + lag])
        for k in np.flatnonzero(~short).tolist():
            part = slice(starts[k], starts[k] + lengths[k])
            u, v = _forest(ids[part], prints[part], radius)
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield rows(u, v)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)]
        block = 0  # number of blocks of the last, unfinished run that have gone out
        for batch in batches:
            fresh = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "print", "bucket", "slot")]
            fresh[1] = fresh[1].view(np.uint64)
            if block and len(fresh[0]):  # rows that still belong to the long run
                open_bucket, open_slot = held[2][0], held[3][0]
                n = int(np.argmin(np.r_[(fresh[2] == open_bucket) & (fresh[3] == open_slot), False]))
                held, fresh = [np.concatenate((h, f[:n])) for h, f in zip(held, fresh, strict=True)], [f[n:] for f in fresh]
                ended = len(fresh[0]) > 0
                while len(held[0]) > BLOCK or (ended and len(held[0])):
                    part, held = [h[:BLOCK] for h in held], [h[BLOCK:] for h in held]
                    yield rows(part[0], part[0], part[2], part[3], part[1].view(np.int64), np.full(len(part[0]), block, np.int32))
                    block += 1
                if not ended:
                    continue
                block = 0
            held = [np.concatenate((h, f)) for h, f in zip(held, fresh, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.flatnonzero(np.r_[True, (held[2][1:] != held[2][:-1]) | (held[3][1:] != held[3][:-1])])[-1])
            whole, held = [h[:cut] for h in held], [h[cut:] for h in held]
            yield from runs(whole)
            while len(held[0]) > 2 * BLOCK:
                part, held = [h[:BLOCK] for h in held], [h[BLOCK:] for h in held]
                yield rows(part[0], part[0], part[2], part[3], part[1].view(np.int64), np.full(len(part[0]), block, np.int32))
                block += 1
        if block:
            yield rows(held[0], held[0], held[2], held[3], held[1].view(np.int64), np.full(len(held[0]), block, np.int32))
        else:
            yield from runs(held)

    def runs(whole) -> Iterator[pa.RecordBatch]:
        ids, prints, buckets, slots = whole
        if not len(ids):
            return
        starts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (slots[1:] != slots[:-1])])
        lengths = np.diff(np.r_[starts, len(ids)])
        long = np.repeat(lengths > BLOCK, lengths)
        if long.any():
            place = np.arange(len(ids)) - np.repeat(starts, lengths)
            out = [x[long] for x in (ids, ids, buckets, slots, prints.view(np.int64), (place // BLOCK).astype(np.int32))]
            yield rows(*out)
        several = np.repeat(lengths > 1, lengths) & ~long
        if several.any():
            yield from closed(ids[several], prints[several], buckets[several], slots[several])

    return apply


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes (id long, print long, distinct prints) to links (u, v), a stored table: they connect exactly what pairs within the radius connect.

    Empty input gives no link. Nodes with a null id or print take no part.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    keyed = nodes.where("id is not null and print is not null").select("id", "print", F.posexplode(masks).alias("slot", "mask"))
    keyed = keyed.select("id", "print", "slot", F.col("mask").bitwiseAND(F.col("print")).alias("bucket"))
    sorted_ = keyed.repartition("slot", "bucket").sortWithinPartitions("slot", "bucket", "print")
    found = stored(sorted_.mapInArrow(_linked(radius), _FOUND), "found")
    waiting = found.where("bucket is not null").select(F.col("u").alias("id"), "print", "slot", "bucket", "block")
    blocks = waiting.groupBy("slot", "bucket").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = waiting.join(blocks, ["slot", "bucket"]).select("id", "print", "slot", "bucket", "block", other.alias("other"))
    met = met.select("id", "print", "slot", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        u, v = _forest(block["id"].to_numpy(), block["print"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"u": u, "v": v})

    late = met.groupBy("slot", "bucket", "low", "high").applyInPandas(compare, "u long, v long")
    links = stored(found.where("bucket is null").select("u", "v").union(late), "links")
    drop_stored(found)
    return links


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs (doc_id, text) to one row per input row: doc_id, print long, component_id.

    component_id is the smallest doc_id reachable over links of at most radius differing bits. Null, empty and
    blank texts have print 0 and are linked like any other. Rows with a null doc_id take the component of their
    fingerprint; a fingerprint that only such rows have is linked to nothing and has a null component_id. Repeated
    rows stay repeated; other columns, whatever their names, are left out; an empty table gives an empty one.
    """
    prints = stored(narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), shingle).alias("print")), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("id")), "nodes")
    links = near_links(nodes, radius)
    roots = connected_components(links)
    rooted = stored(nodes.join(roots, nodes.id == roots.node, "left").select("print", F.coalesce("root", "id").alias("component_id")), "roots")
    drop_stored(nodes, links, roots)
    return prints.join(rooted, "print").select("doc_id", "print", "component_id")


def hex_of(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs without near copies, all columns kept: of each group the row with the smallest doc_id stays.

    Of rows that share that doc_id the one with the least text stays. Rows with a null doc_id stay only if nothing in
    their group has an id, one for each fingerprint.
    """
    groups = stored(near_groups(docs, shingle, radius), "groups")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    keepers = groups.where("doc_id = component_id").select("component_id").distinct()
    best = rows.join(keepers, F.col("own_id") == F.col("component_id")).withColumn("n", F.expr("row_number() over (partition by own_id order by own_text)"))
    lone = groups.where("component_id is null").select("print").distinct()
    unnamed = narrow_batches(rows.where("own_id is null")).withColumn("own_print", fingerprint(F.col("own_text"), shingle))
    unnamed = unnamed.join(lone, F.col("own_print") == F.col("print")).withColumn("n", F.expr("row_number() over (partition by own_print order by own_text)"))
    return best.where("n = 1").select("row").union(unnamed.where("n = 1").select("row")).select("row.*")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", hex_of(F.col("print")).alias("fingerprint"), "component_id")
