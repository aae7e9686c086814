"""The merged table: restarts, repeated batches, bytes, versions; windows of a stream after a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import jobs
from foliospark.sinks.merged import MergedTable

SCHEMA = "k int, kind string, at int, v string"


def batch(spark, draw, n=40):
    return spark.createDataFrame([(draw.choice([None, *range(60)]), draw.choice("ab"), draw.randrange(1000), f"v{draw.randrange(99)}") for _ in range(n)], SCHEMA)


def table(spark, path, **options):
    return MergedTable(spark, str(path), ["k", "kind"], ["at", "v"], **options)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_rows_stay_and_bytes_stay_level(spark, tmp_path):
    draw, own, all_, sizes = random.Random(1), table(spark, tmp_path, buckets=4), None, []
    assert own.read(SCHEMA).count() == 0 and own.size() == 0
    for n in range(12):
        changes = batch(spark, draw)
        own.merge(changes, n)
        all_ = changes if all_ is None else all_.union(changes)
        sizes.append(own.size())
    assert rows(own.read(all_.schema)) == rows(jobs.latest(all_, ["k", "kind"], ["at", "v"]))
    assert max(sizes[6:]) < 1.2 * sizes[5]
    assert len(os.listdir(tmp_path / "manifest")) == 2 and sum(len(d) for _, d, _ in os.walk(tmp_path / "data")) < 40


def test_only_touched_buckets_are_written(spark, tmp_path):
    own = table(spark, tmp_path, buckets=16)
    own.merge(spark.createDataFrame([(i, "a", 1, "x") for i in range(200)], SCHEMA), 0)
    own.merge(spark.createDataFrame([(7, "a", 2, "y"), (7, "a", 0, "z")], SCHEMA), 1)
    assert [x for x in os.listdir(tmp_path / "data/version=1") if x.startswith("bucket")] and len([x for x in os.listdir(tmp_path / "data/version=1") if x.startswith("bucket")]) == 1
    got = {r["k"]: r["v"] for r in own.read(SCHEMA).collect()}
    assert got[7] == "y" and len(got) == 200
    assert {r["k"]: r["v"] for r in own.read(SCHEMA, 0).collect()}[7] == "x"  # as it was before


def test_a_killed_merge_is_repeated_without_doubles(spark, tmp_path):
    draw, own = random.Random(2), table(spark, tmp_path, buckets=4)
    first, second = batch(spark, draw), batch(spark, draw)
    own.merge(first, 0)
    before = rows(own.read(first.schema))
    second.withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/data/version=1")  # data without a manifest
    os.makedirs(tmp_path / "manifest/version=1")  # and one that isn't complete
    assert rows(own.read(first.schema)) == before
    own = table(spark, tmp_path, buckets=4)
    assert own.merge(second, 1) == 1 and own.merge(second, 1) == 1 and own.merge(first, 0) == 1  # batches that are there
    assert rows(own.read(first.schema)) == rows(jobs.latest(first.union(second), ["k", "kind"], ["at", "v"]))


def test_stream_that_fails_between_batches(spark, tmp_path, monkeypatch):
    from foliospark.streaming import ingest

    draw = random.Random(3)
    parts = [batch(spark, draw) for _ in range(3)]
    stream = lambda: spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_upsert(stream(), f"{tmp_path}/t", f"{tmp_path}/c", ["k", "kind"], ["at", "v"], 4)
    plain = MergedTable._drop_unused

    def fails(self, versions):
        raise OSError("lost after the manifest was written")

    for n, part in enumerate(parts):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        if n == 1:
            monkeypatch.setattr(MergedTable, "_drop_unused", fails)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(MergedTable, "_drop_unused", plain)
        run()
    whole = parts[0].union(parts[1]).union(parts[2])
    assert rows(ingest.current(spark, f"{tmp_path}/t", ["k", "kind"], ["at", "v"], whole.schema)) == rows(jobs.latest(whole, ["k", "kind"], ["at", "v"]))
