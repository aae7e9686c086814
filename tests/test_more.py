"""Long texts, listeners, templates, flattening, quantiles, engines' options."""

import time

import pytest
from pyspark.sql import functions as F

from foliospark.engines import registry
from foliospark.functions import extract, text
from foliospark.operators import jobs
from foliospark.sinks import export
from foliospark.sources import files
from foliospark.streaming import ingest


def test_long_texts(spark):
    """A megabyte of each kind of run that patterns begin with: no stack is exhausted, no time grows with its square."""
    n = 1_000_000
    long_ = ["주소: " + "가 나" * (n // 3), "a" * n, "1" * n, "1," * (n // 2), "a.b@" * (n // 4), "주소: " + "서울 " * (n // 3) + "세종로 12", " " * n, "2024년 " * (n // 6), "$" * n, "이름 " * (n // 3)]
    df = spark.createDataFrame(list(enumerate(long_)), "i int, t string").repartition(4)
    began = time.perf_counter()
    got = {r["i"]: r["e"] for r in df.select("i", extract.structured(F.col("t"), False).alias("e")).collect()}
    assert got[5]["address"].endswith("세종로 12") and got[1]["emails"] is None
    assert df.select(F.sum(F.length(text.normalize(F.col("t"))))).first()[0] > 0
    assert time.perf_counter() - began < 120


def test_linear_patterns_find_the_same(spark):
    import random
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab@.co_%1 원,") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a@b.co_x@d.de", "x@y.zz,,1원1,2 원"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", extract.emails(F.col("t")).alias("e"), extract.all_matches(F.col("t"), extract._WON).alias("w")).collect()
    for r in rows:
        assert r["e"] == re.findall(extract.EMAIL, r["t"]) and r["w"] == [m.group(0) for m in re.finditer(r"([\d,]+)\s*원", r["t"])]


def test_quantiles_against_the_built_in(spark):
    rows = [(g, float((i * 37) % 211) if g != "same" else 5.0) for i in range(500) for g in ("a", "same", None)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.25, "mid": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}
    want = {r["g"]: tuple(r[n] for n in shares) for r in df.where("v is not null").groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).collect()}
    got = {r["g"]: tuple(r[n] for n in shares) for r in jobs.quantiles(df, "g", "v", shares).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g], strict=True))


def test_flattened_lists(spark):
    df = spark.createDataFrame([((1, [((2,), "x")]), ["a"])], "doc struct<id:int,items:array<struct<in:struct<n:int>,name:string>>>, tags array<string>")
    out = export.flattened(df)
    assert out.columns == ["doc.id", "doc.items", "tags"] and out.first()["doc.items"][0].asDict() == {"in.n": 2, "name": "x"}
    assert export.FORMATS == ("excel", "csv", "json", "pdf")


def test_templates(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert not files.remove_template(spark, folder, "a")
    files.add_template(spark, folder, "a", "{x} {y} {x}", "d")
    files.add_template(spark, folder, "a", "{z}")
    (tmp_path / "t" / "bad.json").write_text("not json")
    (tmp_path / "t" / "odd.json").write_text('{"template": "x"}')
    assert files.template(spark, folder, "a") == "{z}"
    assert {r["reason"] for r in files.broken_templates(spark, folder).collect()} == {"not JSON", "no name"}
    with pytest.raises(KeyError, match="there are"):
        files.template(spark, folder, "b")
    assert files.remove_template(spark, folder, "a") and files.templates(spark, folder).count() == 0


def test_engines(spark):
    assert registry.configured("sentiment", positive=("yes",))("yes yes bad", 0.1, 1) == "positive"
    for options in ({"positive": 3}, {"other": ()}):
        with pytest.raises(ValueError):
            registry.configured("sentiment", **options)
    df = spark.createDataFrame([(1, "good day"), (2, "bad day"), (3, None)], "document_id int, prompt string")
    got = {r["document_id"]: (r["success"], r["reply"]) for r in registry.generated(df, "classification", "sentiment", tries=1).collect()}
    assert got == {1: (True, "positive"), 2: (True, "negative"), 3: (False, None)}


def test_listener(spark, tmp_path):
    seen = []

    def note(batch, rows):
        seen.append(rows)
        raise RuntimeError("swallowed")

    listener = ingest.Progress(note)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if seen:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(seen) == 7


def test_many_templates_are_few_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(3000).selectExpr("concat('n', id) as name", "'' as description", "'{x} {y}' as template", "id")
    files.store_templates(rows, folder)
    files.store_templates(rows.where("id % 10 = 0").withColumn("template", F.lit("{z}")), folder)
    files.remove_templates(rows.where("id < 3").select("name"), folder)
    files.add_template(spark, folder, "n1", "again")
    got = {r["name"]: (r["template"], r["variables"]) for r in files.templates(spark, folder).collect()}
    want = {f"n{i}": ("{z}", ["z"]) if i % 10 == 0 else ("{x} {y}", ["x", "y"]) for i in range(3, 3000)}
    assert got == want | {"n1": ("again", [])}
    assert sum(not f.name.startswith((".", "_")) for f in (tmp_path / "t").rglob("*") if f.is_file()) < 300


def test_small_files_are_written_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select(F.concat("id", F.lit(".txt")).alias("name"), F.concat(F.lit("text "), "id").cast("binary").alias("content"))
    folders = files.write_files(rows, f"file://{tmp_path}/in", 7).collect()
    assert sum(r["files"] for r in folders) == 300 and len(folders) == 7 and len(list((tmp_path / "in").rglob("*.txt"))) == 300
    (tmp_path / "in" / "f0" / "_hidden.txt").write_bytes(b"no")
    found = files.files_of(spark.createDataFrame(folders), ".txt")
    got = {r["path"]: r for r in found.collect()}
    listed = {r["path"].replace("file:///", "file:/"): r for r in files.binary_files(spark, f"{tmp_path}/in", "*.txt").collect() if "_hidden" not in r["path"]}
    assert found.columns == files.binary_files(spark, f"{tmp_path}/in").columns and {p.replace("file:///", "file:/") for p in got} == set(listed)
    assert all(listed[p.replace("file:///", "file:/")]["sha256"] == r["sha256"] and r["file_size"] == len(r["content"]) and r["file_type"] == "txt" and r["year"] > 2000 for p, r in got.items())
