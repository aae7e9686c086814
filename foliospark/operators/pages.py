"""Pages of a document: merging and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text, confidence) to one row per document: text in page order with a header line for each page, page count and mean confidence.

    A document's text is one value, so all its pages meet in one task: a document larger than an executor's memory can't be merged.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    joined = F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("--- 페이지 "), p["page_number"], F.lit(" ---\n\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")
    return pages.groupBy("document_id").agg(joined.alias("text"), F.count("*").alias("page_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def synced(pages: DataFrame, documents: DataFrame, fields: tuple) -> DataFrame:
    """One row per document for another store: the chosen fields and the text of its pages, joined by line ends."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    texts = pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))
    return documents.select("document_id", *fields).join(texts, "document_id", "left")


def word_confidence(boxes: Column) -> Column:
    """Mean of conf / 100 over the boxes of a page, those marked -1 left out; 0 where there are none."""
    good = F.transform(F.filter(boxes, lambda b: b["conf"] != -1), lambda b: b["conf"] / 100.0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good)).otherwise(0.0)


def real_boxes(boxes: Column) -> Column:
    """Boxes with text and a confidence."""
    return F.filter(boxes, lambda b: (F.trim(b["text"]) != "") & (b["conf"] != -1))
