"""Pages of files by ranges, against the files split as a whole."""

import random

from foliospark.sources import paged


def test_every_page_belongs_to_one_range_however_files_are_cut(tmp_path, monkeypatch):
    draw = random.Random(1)
    monkeypatch.setattr(paged, "BUFFER", 5)
    for case in [b"", b"\f", b"\f\f", b"a", b"a\f", b"a\fb", b"\fa\f\fbb\f", *[bytes(draw.choice(b"ab\f") for _ in range(60)) for _ in range(20)]]:
        (tmp_path / "x").write_bytes(case)
        want = case.split(b"\f")
        want = want[:-1] if not want[-1] else want
        for size in (1, 2, 3, 7, 100):
            spans = [paged.Span(str(tmp_path / "x"), a, min(len(case), a + size)) for a in range(0, len(case), size)]
            got = [p for s in spans for p in paged.pages_of(s)]
            assert [content for _, content in got] == want and len({at for at, _ in got}) == len(got), (case, size)


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    pages = [f"page {i} " + "x" * (i % 50) for i in range(500)]
    (tmp_path / "a.txt").write_bytes("\f".join(pages).encode())
    (tmp_path / "b.txt").write_bytes(b"good\f\xff\xfe\f\fend")
    (tmp_path / "_hidden.txt").write_bytes(b"no")
    (tmp_path / "c.bin").write_bytes(b"no")
    rows = paged.pages(spark, str(tmp_path), suffix=".txt", range=1000)
    assert rows.rdd.getNumPartitions() >= 1 and spark.read.format("foliopages").options(path=str(tmp_path), suffix=".txt", range="1000").load().rdd.getNumPartitions() > 15
    got = sorted((r["path"].rsplit("/", 1)[1], r["page_number"], r["text"], r["error"] is not None) for r in rows.collect())
    want = [("a.txt", i + 1, p, False) for i, p in enumerate(pages)] + [("b.txt", 1, "good", False), ("b.txt", 2, None, True), ("b.txt", 3, "", False), ("b.txt", 4, "end", False)]
    assert got == sorted(want)
    assert paged.pages(spark, str(tmp_path / "none")).count() == 0


def test_stream_goes_on_after_the_last_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, text in enumerate(["a\fb", "c", "d\fe\ff"]):
        (tmp_path / "in" / f"{n}.txt").write_text(text)
        query = paged.page_stream(spark, str(tmp_path / "in"), range=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("abcdef")


def test_short_ranges_share_tasks_and_read_little_more_than_themselves(tmp_path, monkeypatch):
    (tmp_path / "x.txt").write_bytes(b"\f".join(b"page %d" % i + b"x" * 900 for i in range(2000)))
    size, read, opened = (tmp_path / "x.txt").stat().st_size, [], paged._opened

    class Counting:
        def __init__(self, file):
            self.file = file
        def __enter__(self):
            return self
        def __exit__(self, *_):
            self.file.close()
        def read(self, n):
            read.append(len(got := self.file.read(n)))
            return got
        def __getattr__(self, name):
            return getattr(self.file, name)

    class System:
        def open_input_file(self, place):
            return Counting(opened(place)[0].open_input_file(place))
    reader = paged._Reader({"path": str(tmp_path), "range": "8192"})
    tasks = reader.partitions()
    assert 40 < len(tasks) <= 64
    monkeypatch.setattr(paged, "_opened", lambda path: (System(), path))
    rows = [r for t in tasks for r in reader.read(t)]
    assert [r[4][:9].rstrip("x") for r in rows] == [f"page {i}" for i in range(2000)] and sum(read) < 2.5 * size


def test_pages_are_counted_without_an_engine(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"none\fnone\fb\f\xff\fc")
    for size in (3, 5, 100):
        last = paged._Reader({"path": str(tmp_path), "range": str(size), "last": "true"})
        assert sum(r[3] + 1 for t in last.partitions() for r in last.read(t)) == 5
