"""The pipeline on the smallest tables: each stage against what it promises, and the registered queries against their SQL."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing, pieces, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "mix_sources", "sentencepiece"]
    kept = docs.limit(60).unionByName(docs.limit(5)).cache()
    unique = corpus_pipeline.drop_near_copies(spark, kept, FOLDER)
    groups = simhash.near_groups(kept).collect()
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({g["component_id"] for g in groups})
    mixed = corpus_pipeline.mix_sources(spark, unique, FOLDER)
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(unique, whole=True).collect()}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in plan.items() if n}
    last = corpus_pipeline.encode(spark, mixed, FOLDER)
    back = last.withColumn("text", pieces.decoded(F.col("piece_ids"), pieces.load_model()))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in mixed.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "source", "n_pieces", "piece_ids"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r[n] for n in names) for r in queries.queries()[name](spark, FOLDER).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_tables(spark, tmp_path):
    """Every stage takes an empty predecessor."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0, name


def test_nulls_in_any_column(spark):
    rows = [(None, "some text", None, None, None), (1, None, "en", "a", 3), (2, "", None, None, 0), (3, "one two three", "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        sizes[name] = docs.count()
    assert sizes["toxicity"] == 4 and sizes["simhash_near_dedup"] == 3
