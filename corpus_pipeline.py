"""Corpus pipeline: filter, deduplicate, redact, mix and tokenise documents, a stage at a time.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are a Parquet table in the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import jaccard, mixing, pieces, secret_scan, toxicity
from foliospark.llm.common import drop_stored, fold, narrow_batches, stored


#: Characters of distinct words that an encoding task keeps: the stages before leave workers with less room than the operator alone has.
CACHED = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under 0.5 stay; the network learns from the table's labels.

    Null, empty and wordless texts stay. Repeated rows stay or go together; other columns, whatever their names, are
    kept; an empty table gives an empty one. Texts are scored whole, a bounded part at a time.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    weights = toxicity.fitted(docs, labels)
    scored = narrow_batches(docs).select(F.struct("*").alias("row"), toxicity.toxicity(F.col("text"), weights).alias("score"))
    return scored.where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a Jaccard similarity of 0.8 or more of 5-word shingles the document with the smallest doc_id stays.

    Null, empty and blank texts are one group; of rows with one doc_id the least text stays; rows without an id stay
    only where a group has no other, one for each group; all columns are kept; an empty table gives an empty one.
    """
    return jaccard.near_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones and null texts too; confirmed secrets in their texts become a sign and n_chars is counted anew."""
    return secret_scan.redacted(docs, secret_scan.trained(spark), path="source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole: repeated ones are repeated rows, those not drawn go.

    A null source is one of its own; null texts count as empty; all columns are kept; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of each document; null and empty texts have none; repeated rows stay; other columns are left out."""
    coded = pieces.encode_documents(docs.select("doc_id", "source", "text"), cache=CACHED)
    return coded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: A trained network, a forest and a tokenizer model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder, one after another."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
