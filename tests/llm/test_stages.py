"""Each stage of the pipeline on small planted documents against what plain Python says."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from foliospark.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, copy int, repeats int, keep long, n int, parts string, piece_ids string"
REST = ("r", 0.5, 7, 7, 7, 7, "p", "q")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and documents in which some words are vile."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("planted")
    words = [a + b + c for a in ("ka", "lo", "mi", "tu", "se") for b in ("re", "no", "st") for c in ("", "n", "ra")]
    rows, toxic = [], {}
    for i in range(260):
        text = rng.choices(words, k=rng.randrange(30, 120))
        toxic[i] = i % 4 == 0
        for _ in range(4 if toxic[i] else 0):
            text[rng.randrange(len(text))] = rng.choice(["vileword", "filthword"])
        text = " ".join(text)
        rows.append((i, text, "en", f"s{i % 3}", len(text), *REST))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, toxic


def test_toxic_documents_go(spark, folder):
    path, rows, toxic = folder
    more = [(900, None, None, None, None, *[None] * 8), (901, "", "en", "s0", 0, *REST), (901, "", "en", "s0", 0, *REST)]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    out = corpus_pipeline.drop_toxic(spark, docs, path)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    clean, bad = [i for i, y in toxic.items() if not y], [i for i, y in toxic.items() if y]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in bad) <= 0.05 * len(bad)
    assert kept.count(900) == 1 and kept.count(901) == 2


def test_near_copies_go(spark):
    base = [f"w{i}" for i in range(200)]
    near, far = base[:100] + ["x"] + base[101:], base[:100] + [f"y{i}" for i in range(100)]
    texts = {5: base, 3: near, 8: base, 9: far, 4: ["lone"]}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1, *REST) for i, t in texts.items()], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 4, 9]
    assert all(r["row"] == "r" and r["keep"] == 7 for r in out.collect())


def test_secrets_are_redacted(spark):
    key = "AKIA" + "QWERTYUIOP234567"
    rows = [(1, f"see {key} there", "en", "a", 30, *REST), (2, "see commit 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c there", "en", "a", 56, *REST), (3, None, "en", None, None, *REST)]
    out = corpus_pipeline.redact_secrets(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, out.collect())) == [(1, "see [SECRET] there", "en", "a", 18, *REST), rows[1], rows[2]]


def test_mix_keeps_columns(spark):
    """Sources in code-point order weigh 5, 2, 1; 150 % of 400 words by water-filling are 400, 133.3 and 66.7, capped at 200, 200 and 400."""
    rows = [(i, " ".join("w" * 10), "en", s, 19, *REST) for i, s in enumerate(["a"] * 10 + ["b"] * 10 + ["c"] * 20)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == spark.createDataFrame(rows[:1], SCHEMA).columns
    assert {tuple(r) for r in out.collect()} <= set(rows)
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 20, "b": 20, "c": 20}


def test_encoding_reads_back(spark):
    rows = [(1, "Hello  world\n", "en", "a", 1, *REST), (1, "Hello  world\n", "en", "a", 1, *REST), (2, None, None, None, None, *REST), (None, "", "en", "a", 0, *REST)]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == ["doc_id", "source", "n_pieces", "piece_ids"]
    back = out.withColumn("text", pieces.decoded(F.col("piece_ids"), pieces.load_model())).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_pieces"] == len(r["piece_ids"])) for r in back) == sorted((str(i), t or "", True) for i, t, *_ in rows)
