"""Media files and not-modified records."""

import hashlib
import random
import struct
import zlib

import pytest

from foliospark.llm import media, warc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 300_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stored = media.pad(payload)
    assert len(stored) % 64 == 0 and stored and stored[:n] == payload and not any(stored[n:])
    file = media.write_media(stored)
    whole = media.read_media(file)
    (facts,) = whole["tracks"]
    assert whole["error"] is None and whole["fragments"] == 0 and facts["handler"] == "soun" and facts["track_id"] == 1 and facts["codec"] == "raw " and facts["timescale"] == 8000 and facts["duration"] == len(stored)
    assert b"".join(file[s["offset"] : s["offset"] + s["length"]] for s in facts["payload"]) == stored
    assert facts["keyframes"] == -(-len(stored) // 64 // 16) == len(facts["spans"])
    begin = facts["payload"][0]["offset"]
    assert [s["offset"] - begin for s in facts["spans"]] == list(range(0, len(stored), 1024))


def test_several_chunks_and_wide_boxes():
    """A file of another writer: media data first, two chunks apart, wide sizes, differing sample sizes."""
    box, full = media._box, media._full
    ftyp = box(b"ftyp", b"mp42", bytes(4))
    data = b"AAAbbbbb--CCd"
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    at = len(ftyp) + 16
    stbl = box(
        b"stbl",
        full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"avc1", bytes(8))),
        full(b"stts", 0, 0, struct.pack(">IIIII", 2, 3, 10, 1, 7)),
        full(b"stss", 0, 0, struct.pack(">III", 2, 1, 3)),
        full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 2, 1)),
        full(b"stsz", 0, 0, struct.pack(">IIIIII", 0, 4, 3, 5, 2, 1)),
        full(b"co64", 0, 0, struct.pack(">IQQ", 2, at, at + 10)),
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 90, 5)), box(b"minf", stbl))))
    (facts,) = media.read_media(ftyp + mdat + moov)["tracks"]
    assert (facts["codec"], facts["timescale"], facts["duration"], facts["samples"]) == ("avc1", 90, 37, 4)
    assert facts["spans"] == [{"offset": at, "length": 3}, {"offset": at + 10, "length": 2}]
    assert facts["payload"] == [{"offset": at, "length": 8}, {"offset": at + 10, "length": 3}]


def _track(number, handler, codec, sizes, places, keys=None):
    """A track of a foreign writer with one chunk a sample."""
    box, full = media._box, media._full
    stss = [full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys))] if keys is not None else []
    stbl = box(
        b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", 0, 0, struct.pack(">III", 1, len(sizes), 5) if sizes else struct.pack(">I", 0)), *stss,
        full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 1, 1) if sizes else struct.pack(">I", 0)), full(b"stsz", 0, 0, struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), full(b"stco", 0, 0, struct.pack(f">I{len(places)}I", len(places), *places)),
    )
    tkhd = full(b"tkhd", 0, 7, struct.pack(">III", 0, 0, number), bytes(68))
    mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 600 + number, 0)), full(b"hdlr", 0, 0, bytes(4), handler, bytes(13)), box(b"minf", stbl))
    return box(b"trak", tkhd, mdia)


def test_all_tracks_and_every_keyframe():
    """The sound track comes first; each keyframe keeps its own range although they touch."""
    data = b"sssVVVVvvvv"
    mdat = media._box(b"mdat", data)
    moov = media._box(b"moov", _track(2, b"soun", b"mp4a", [1, 1, 1], [8, 9, 10]), _track(7, b"vide", b"avc1", [4, 2, 2], [11, 15, 17], [1, 3]))
    sound, video = media.read_media(mdat + moov)["tracks"]
    assert (sound["track_id"], sound["handler"], sound["codec"], sound["keyframes"]) == (2, "soun", "mp4a", 3)
    assert sound["spans"] == [{"offset": i, "length": 1} for i in (8, 9, 10)] and sound["payload"] == [{"offset": 8, "length": 3}]
    assert (video["track_id"], video["codec"], video["timescale"], video["duration"], video["samples"]) == (7, "avc1", 607, 15, 3)
    assert video["spans"] == [{"offset": 11, "length": 4}, {"offset": 17, "length": 2}]


def test_fragments():
    """Samples of movie fragments: defaults of the movie and of the fragment, sizes and flags of the runs, two runs, two tracks."""
    box, full = media._box, media._full
    trex = lambda n, size: full(b"trex", 0, 0, struct.pack(">5I", n, 1, 10, size, media._NO_KEY))
    moov = box(b"moov", _track(1, b"vide", b"hvc1", [], []), _track(2, b"soun", b"mp4a", [], []), box(b"mvex", trex(1, 0), trex(2, 3)))

    def moof(data_at):
        video = box(b"traf", full(b"tfhd", 0, media._FROM_MOOF, struct.pack(">I", 1)),
            full(b"trun", 0, media._RUN_OFFSET | media._RUN_FIRST | media._RUN_SIZE, struct.pack(">IiI3I", 3, data_at, 0, 5, 4, 3)), full(b"trun", 0, media._RUN_SIZE | media._RUN_FLAGS, struct.pack(">I4I", 2, 2, 0, 1, media._NO_KEY)))
        sound = box(b"traf", full(b"tfhd", 0, media._FROM_MOOF | media._FLAGS, struct.pack(">II", 2, 0)), full(b"trun", 0, media._RUN_OFFSET, struct.pack(">Ii", 2, data_at + 15)))
        return box(b"moof", full(b"mfhd", 0, 0, struct.pack(">I", 1)), video, sound)

    part = moof(len(moof(0)) + 8)
    file = moov + part + box(b"mdat", b"VVVVVvvvvvvvVVvssssss")
    begin = len(moov) + len(part) + 8
    found = media.read_media(file)
    assert found["error"] is None and found["fragments"] == 1
    video, sound = found["tracks"]
    assert (video["samples"], video["keyframes"], video["duration"], sound["samples"], sound["keyframes"]) == (5, 2, 50, 2, 2)
    assert video["spans"] == [{"offset": begin, "length": 5}, {"offset": begin + 12, "length": 2}]
    assert video["payload"] == [{"offset": begin, "length": 15}] and sound["payload"] == [{"offset": begin + 15, "length": 6}]
    assert media.read_media(moov + box(b"moof", box(b"traf", full(b"tfhd", 0, 0, struct.pack(">I", 9)))))["error"] == "a fragment of no track"


def test_damage_is_reported():
    file = media.write_media(media.pad(b"x" * 100))
    for bad in (None, b"", b"abc", file[:300], file[:24] + b"\xff" * 4 + file[28:], bytes(2000)):
        assert media.read_media(bad)["error"]
    sizes = file.index(b"stsz")
    huge = file[: sizes + 12] + b"\xff" * 4 + file[sizes + 16 :]
    assert media.read_media(huge)["error"] == "the samples are larger than the file"
    rng = random.Random(1)
    for _ in range(3000):  # any damage gives facts or an error, never an exception
        bad = bytearray(file)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.choice([0, 255, rng.randrange(256)])
        media.read_media(bytes(bad[: rng.randrange(len(bad) // 2, len(bad) + 1)]))


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "x" * 64), (5, "x" * 64), (None, "🙂")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op2_media_columns(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        file = media.write_media(padded)
        assert padded in file
        want.append((i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest()))
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256".split()
    key = lambda r: str(r)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)
    assert {r["feature"] for r in got if r["doc_id"] == 1} == {"codec=raw ;seconds=0.008;samples=1;keyframes=1;first=" + f"{len(media.write_media(bytes(64))) - 64}+64"}


def test_media_columns(spark):
    rows = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é" * 5000, 0), (4, "é" * 5000, 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    out = media.media_columns(df).collect()
    assert len(out) == 6 and all(r["facts"]["error"] is None for r in out)
    assert sorted(r["n_bytes"] for r in out) == [0, 0, 1, 3, 10000, 10000]
    assert media.media_columns(df.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "HTTP://www2.Example.org:80/a/b/?b=2&utm_source=x&a=1#top": "example.org/a/b?a=1&b=2", "https://example.org": "example.org", "https://u:p@example.org:8080/": "example.org:8080",
        "https://example.org/x?": "example.org/x", "": None, "no url": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r[0]: r[1] for r in df.select("u", warc.canonical_url(df.u)).collect()}
    assert got == cases


def test_revisits_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = rng.choice(["http://a.org/x", "https://www.a.org/x/", "http://b.org", "http://c.org/?q=1", None, "bad"]) if i % 3 else "http://hot.org/"
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        head = rng.choice(['ETag: "1"', 'ETag: W/"1"', 'etag: "2"', "Last-Modified: d1", 'ETag: "1"\r\nLast-Modified: d2', "X: y", None])
        rows.append((i, kind, url, rng.choice([None, *range(0, 900_000, 7919)]), head, "extra"))
    df = spark.createDataFrame(rows, "record_id long, warc_type string, url string, ts long, headers string, verdict string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    canon = {r[0]: r[1] for r in df.select("record_id", warc.canonical_url(df.url)).collect()}

    def parse(block):
        return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in (block or "").split("\r\n") if ":" in x)}

    full = [r for r in rows if r[1] == "response" and canon[r[0]] and r[3] is not None]
    for i, kind, _, ts, head, _ in rows:
        if kind != "revisit":
            assert i not in got
            continue
        own, verdict, expected = parse(head), None, None
        if canon[i] is None or ts is None:
            verdict = "no_key"
        else:
            before = [(r[3], r[0], r[4]) for r in full if canon[r[0]] == canon[i] and r[3] < ts]
            if not before:
                verdict = "no_response"
            else:
                _, expected, block = max(before, key=lambda x: x[:2])
                theirs = parse(block)
                verdict = "no_validator"
                for name in ("etag", "last-modified"):
                    if name in own and name in theirs:
                        verdict = "resolved" if own[name].removeprefix("W/") == theirs[name].removeprefix("W/") else "mismatch"
                        break
        assert (got[i]["verdict"], got[i]["response_id"]) == (verdict, expected), rows[i]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_merged_headers(spark):
    rows = [(1, "response", "http://a.org", 10, "Content-Type: t\r\nContent-Length: 9\r\nETag: x\r\nCache-Control: a"), (2, "revisit", "http://a.org", 20, "content-length: 0\r\nETag: x\r\nCache-Control: b\r\nCache-Control: c\r\nX-New: 1")]
    out = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, warc_type string, url string, ts long, headers string")).first()
    assert out["headers"] == {"content-type": "t", "content-length": "9", "etag": "x", "cache-control": "b, c", "x-new": "1"}
