"""Media columns: ISO base media files, written around 8-bit samples and read by walking their boxes.

The reader never looks into the media data itself: it follows sizes and sample tables only, so its cost depends on the
number of boxes and samples. Frames may be split over chunks and the tables may come before or after the data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import narrow_batches

#: Fixed values of the file format: boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Samples (bytes) to a second, bytes of one stored sample (frame), frames of one chunk.
RATE, FRAME, CHUNK_FRAMES = 8000, 64, 64
#: Boxes may be nested this deep; deeper ones count as damage.
DEPTH = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """With bytes 0 up to the next positive multiple of a frame."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def write_media(payload: bytes, key_every: int = 16) -> bytes:
    """One track of unsigned 8-bit mono samples in frames of 64 bytes; each key_every-th frame is marked as a keyframe.

    payload: a positive multiple of 64 bytes, kept as it is.
    """
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)]
    keys = np.arange(1, frames + 1, key_every, dtype=">u4")

    def moov(begin: int) -> bytes:
        offsets = begin + np.arange(chunks, dtype=np.int64) * (FRAME * CHUNK_FRAMES)
        wide = begin + len(payload) >= 1 << 32
        entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        places = _full(b"co64", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", 0, 0, struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            places,
        )
        minf = _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), stbl)
        mdhd = _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _full(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    wide = len(payload) + 8 >= 1 << 32
    data = (struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")) + payload
    begin = len(head) + len(moov(0)) + (16 if wide else 8)
    return head + moov(begin) + data


def boxes(data: memoryview, at: int, end: int, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, begin, end) of each box's body, outer ones first; size 0 runs to the end, size 1 has 64 bits."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box's wide size is cut off")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} goes beyond what holds it")
        body += 16 if kind == b"uuid" else 0
        yield depth, kind, body, stop
        if kind in CONTAINERS:
            if depth >= DEPTH:
                raise ValueError("boxes are nested too deeply")
            yield from boxes(data, body, stop, depth + 1)
        at = stop


def _numbers(data: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    if n * np.dtype(kind).itemsize > end - at:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _sample_sizes(data: memoryview, table: dict) -> np.ndarray:
    if b"stsz" in table:
        at, end = table[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        if same:
            if same * n > len(data):  # before room for that many is taken
                raise ValueError("the samples are larger than the file")
            return np.full(n, same, np.int64)
        return _numbers(data, at + 12, end, ">u4", n)
    at, end = table[b"stz2"]
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if width == 4:
        pairs = _numbers(data, at + 12, end, ">u1", -(-n // 2))
        return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n]
    return _numbers(data, at + 12, end, {8: ">u1", 16: ">u2"}[width], n)


def _sample_places(data: memoryview, table: dict, sizes: np.ndarray) -> np.ndarray:
    """First byte of each sample, from the chunks' places and how many samples each chunk holds."""
    kind, wide = (b"co64", ">u8") if b"co64" in table else (b"stco", ">u4")
    at, end = table[kind]
    chunks = _numbers(data, at + 8, end, wide, struct.unpack_from(">I", data, at + 4)[0])
    at, end = table[b"stsc"]
    runs = _numbers(data, at + 8, end, ">u4", 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
    if not len(sizes):
        return np.empty(0, np.int64)
    held = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]))
    if held.sum() != len(sizes) or len(held) != len(chunks):
        raise ValueError("the chunks don't hold as many samples as have sizes")
    ahead = np.cumsum(sizes) - sizes
    first = np.cumsum(held) - held
    in_chunk = ahead - np.repeat(ahead[np.minimum(first, len(sizes) - 1)], held)
    return np.repeat(chunks, held) + in_chunk


def _whole_track(data: memoryview, table: dict) -> dict:
    """Places, sizes, keyframes and duration of a track by its sample tables."""
    sizes = _sample_sizes(data, table)
    places = _sample_places(data, table, sizes)
    at, end = table[b"stts"]
    steps = _numbers(data, at + 8, end, ">u4", 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
    keys = np.ones(len(sizes), bool)
    if b"stss" in table:
        at, end = table[b"stss"]
        numbers = _numbers(data, at + 8, end, ">u4", struct.unpack_from(">I", data, at + 4)[0]) - 1
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(sizes)):
            raise ValueError("a keyframe is no sample")
        keys[:] = False
        keys[numbers] = True
    return {"places": [places], "sizes": [sizes], "keys": [keys], "duration": int((steps[:, 0] * steps[:, 1]).sum())}


#: Fixed values of the file format: flags of a track fragment and of its runs, and the sample flag that says "no keyframe".
_BASE_OFFSET, _DESCRIPTION, _DURATION, _SIZE, _FLAGS, _FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
_NO_KEY = 0x10000


class _Fragments:
    """Samples that fragments add to tracks."""

    def __init__(self, data: memoryview, tracks: dict, defaults: dict) -> None:
        self.data, self.tracks, self.defaults = data, tracks, defaults
        self.moof, self.track, self.base, self.next = 0, None, 0, None
        self.own = (0, 0, 0)  # duration, size and flags of a sample that doesn't say

    def header(self, at: int) -> None:
        flags, number = struct.unpack_from(">II", self.data, at)
        at, flags = at + 8, flags & 0xFFFFFF
        self.track, first = self.tracks.get(number), self.next is None
        if self.track is None:
            raise ValueError("a fragment of no track")
        self.base = self.moof if flags & _FROM_MOOF or first or self.next is None else self.next
        if flags & _BASE_OFFSET:
            (self.base,), at = struct.unpack_from(">Q", self.data, at), at + 8
        at += 4 if flags & _DESCRIPTION else 0
        own = list(self.defaults.get(number, (0, 0, 0)))
        for i, bit in enumerate((_DURATION, _SIZE, _FLAGS)):
            if flags & bit:
                (own[i],), at = struct.unpack_from(">I", self.data, at), at + 4
        self.own, self.next = tuple(own), self.base

    def run(self, at: int, end: int) -> None:
        if self.track is None:
            raise ValueError("a run of samples outside of a track fragment")
        flags, n = struct.unpack_from(">II", self.data, at)
        at, flags = at + 8, flags & 0xFFFFFF
        place, first = self.next, None
        if flags & _RUN_OFFSET:
            (offset,), at = struct.unpack_from(">i", self.data, at), at + 4
            place = self.base + offset
        if flags & _RUN_FIRST:
            (first,), at = struct.unpack_from(">I", self.data, at), at + 4
        fields = [bit for bit in (_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT) if flags & bit]
        if not fields and self.own[1] * n > len(self.data) or not fields and not self.own[1] and n > len(self.data):
            raise ValueError("the samples are larger than the file")
        rows = _numbers(self.data, at, end, ">u4", n * len(fields)).reshape(n, len(fields))

        def each(bit: int, default: int) -> np.ndarray:
            return rows[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)

        sizes, marks = each(_RUN_SIZE, self.own[1]), each(_RUN_FLAGS, self.own[2])
        if first is not None and n:
            marks[0] = first
        self.track["places"].append(place + np.cumsum(sizes) - sizes)
        self.track["sizes"].append(sizes)
        self.track["keys"].append(marks & _NO_KEY == 0)
        self.track["duration"] += int(each(_RUN_DURATION, self.own[0]).sum())
        self.next = place + int(sizes.sum())


_TABLES = (b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64")
_NOTHING = {"error": None, "brand": None, "n_boxes": None, "fragments": None, "tracks": None}


def read_media(data: bytes | None) -> dict:
    """Facts of a file: brand, n_boxes, fragments (their number) and tracks in the order of the file.

    Of each track: track_id, handler, codec, timescale, duration (units), samples, keyframes (number), spans (offset and
    length of each keyframe, one by one) and payload (byte ranges of all samples, those that touch joined). Samples of
    movie fragments come after those of the track's own tables. Damaged, empty or missing data gives an error and
    nothing else; no table is taken at its word beyond what the file's size allows.
    """
    if data is None:
        return _NOTHING | {"error": "no data"}
    view, tables, tracks, defaults, brand, n, n_fragments = memoryview(data), [], {}, {}, None, 0, 0
    try:
        for _, kind, at, end in boxes(view, 0, len(view)):
            n += 1
            if kind == b"ftyp":
                brand = bytes(view[at : at + 4]).decode("latin-1")
            elif kind == b"trak":
                tables.append({"number": len(tables) + 1, "timescale": None, "duration": None, "handler": None})
            elif kind == b"trex":
                number, _, *own = struct.unpack_from(">5I", view, at + 4)
                defaults[number] = tuple(own)
            elif kind == b"tkhd" and tables:
                tables[-1]["number"] = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]
            elif kind == b"mdhd" and tables:
                tables[-1]["timescale"], tables[-1]["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
            elif kind == b"hdlr" and tables and tables[-1]["handler"] is None:
                tables[-1]["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
            elif kind in _TABLES and tables:
                tables[-1][kind] = at, end
            elif kind == b"moof":
                if not n_fragments:
                    tracks |= {t["number"]: t | _whole_track(view, t) for t in tables}
                    fragments = _Fragments(view, tracks, defaults)
                n_fragments += 1
                fragments.moof, fragments.track, fragments.next = at - 8, None, None
            elif kind == b"tfhd" and n_fragments:
                fragments.header(at)
            elif kind == b"trun" and n_fragments:
                fragments.run(at, end)
        if not tables:
            raise ValueError("no track")
        if len({t["number"] for t in tables}) < len(tables):
            raise ValueError("two tracks of one number")
        if not n_fragments:
            tracks |= {t["number"]: t | _whole_track(view, t) for t in tables}
        out = []
        for t in tracks.values():
            places, sizes, keys = (np.concatenate(t[k]) for k in ("places", "sizes", "keys"))
            if len(places) and ((places + sizes).max() > len(view) or places.min() < 0):
                raise ValueError("samples lie beyond the file")
            at = t[b"stsd"][0]
            spans = [{"offset": a, "length": b} for a, b in zip(places[keys].tolist(), sizes[keys].tolist(), strict=True)]
            out.append({
                "track_id": t["number"], "handler": t["handler"], "codec": bytes(view[at + 12 : at + 16]).decode("latin-1"), "timescale": t["timescale"], "duration": t["duration"] or tables[len(out)]["duration"],
                "samples": len(sizes), "keyframes": int(keys.sum()), "spans": spans, "payload": _joined(places, sizes),
            })
        return {"error": None, "brand": brand, "n_boxes": n, "fragments": n_fragments, "tracks": out}
    except (ValueError, KeyError, struct.error, IndexError, OverflowError, MemoryError) as broken:
        missing = isinstance(broken, KeyError)
        return _NOTHING | {"error": f"no {broken} table" if missing else str(broken)[:120] or "damaged"}


def _joined(places: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Byte ranges in order, those that touch joined."""
    if not len(places):
        return []
    new = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + sizes[:-1]])
    lengths = np.add.reduceat(sizes, new)
    return [{"offset": int(a), "length": int(b)} for a, b in zip(places[new], lengths, strict=True)]


_SPANS = "array<struct<offset:bigint,length:bigint>>"
_TRACK = f"struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:bigint,spans:{_SPANS},payload:{_SPANS}>"
_FACTS = f"struct<error:string,brand:string,n_boxes:bigint,fragments:bigint,tracks:array<{_TRACK}>>"


def store_text(text: Column) -> Column:
    """The text's UTF-8 bytes, padded, as a media file; null counts as empty."""

    @F.pandas_udf("binary")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([write_media(pad(x or b"")) for x in texts], dtype=object)

    return apply(text.cast("binary"))


def media_facts(media: Column) -> Column:
    """Struct of what read_media() finds, for any column of ISO media files; null gives the error "no data"."""

    @F.pandas_udf(_FACTS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            found = [read_media(x) for x in files]
            frame = pd.DataFrame({n: pd.Series([x[n] for x in found], dtype=object) for n in _NOTHING})
            yield frame.astype({n: "Int64" for n in ("n_boxes", "fragments")})

    return apply(media)


def bytes_at(media: Column, spans: Column) -> Column:
    """The bytes of a file in the given ranges, one after another, on the JVM."""
    empty = F.lit("").cast("binary")
    parts = F.transform(spans, lambda s: F.substring(media, (s["offset"] + 1).cast("int"), s["length"].cast("int")))
    return F.when(F.size(spans) == 1, F.substring(media, (spans[0]["offset"] + 1).cast("int"), spans[0]["length"].cast("int"))).otherwise(
        F.aggregate(parts, empty, lambda a, b: F.concat(a, b))
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes, media (the stored file) and facts (read back from it); one row per input row.

    Null and empty texts are stored as one frame of zeros. Repeated rows stay, a null doc_id stays null, other columns
    of any name are left out, an empty table gives an empty one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = narrow_batches(docs).select("doc_id", size.alias("n_bytes"), store_text(F.col("text")).alias("media"))
    return stored.withColumn("facts", media_facts(F.col("media")))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """The whole payload is read back from the ranges that the reader finds; the spans of all keyframes come along."""
    read = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    read = read.withColumn("track", F.get("facts.tracks", F.lit(0))).withColumn("payload", bytes_at(F.col("media"), F.col("track.payload")))
    first = F.get("track.spans", F.lit(0))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.col("track.codec")),
        F.concat(F.lit("seconds="), F.format_string("%.3f", F.col("track.duration") / F.col("track.timescale"))),
        F.concat(F.lit("samples="), F.col("track.samples")),
        F.concat(F.lit("keyframes="), F.col("track.keyframes")),
        F.concat(F.lit("first="), first["offset"], F.lit("+"), first["length"]),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -FRAME, FRAME)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("track.spans").alias("keyframe_spans"),
    )
