"""Registered queries over the search index. Each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import search
from foliospark.plans.registry import query
from foliospark.sources.files import table
from foliospark.streaming.ingest import scratch

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_RANKED = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM DOCS), total AS (SELECT count(*) AS docs, greatest(1, avg(len(w))) AS mean FROM d),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
  scored AS (SELECT query_id, doc_id AS document_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)))), 6) AS score
    FROM q JOIN p USING (term) JOIN df USING (term) JOIN d USING (doc_id), total GROUP BY ALL)"""


def _indexed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.coalesce("lang", F.lit("none")).alias("part"))
    path = scratch(spark)
    search.write_index(docs, path)
    return docs, path


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_RANKED.replace('DOCS', 'documents')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INT AS rank, document_id, score FROM scored QUALIFY rank <= 10")
def ranked_search(spark, d):
    """The ten best documents for each benchmark passage, by an index with a part for each language."""
    _, path = _indexed(spark, d)
    return search.search(spark, path, _queries(spark, d))


_EDITED = "(SELECT doc_id, CASE WHEN lang = 'en' THEN reverse(text) ELSE text END AS text FROM documents)"


@query(f"WITH {_RANKED.replace('DOCS', _EDITED)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INT AS rank, document_id, score FROM scored QUALIFY rank <= 10")
def search_after_update(spark, d):
    """The same after the English documents have changed and their part of the index was written anew."""
    docs, path = _indexed(spark, d)
    search.write_index(docs.where("part = 'en'").withColumn("text", F.reverse("text")), path)
    return search.search(spark, path, _queries(spark, d))


@query(r"""WITH q AS (SELECT item_id AS query_id, list_aggregate(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[3:8], 'string_agg', ' ') AS words FROM benchmark)
  SELECT DISTINCT query_id, doc_id AS document_id FROM q JOIN (SELECT doc_id, ' ' || list_aggregate(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'string_agg', ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL) d ON contains(t, ' ' || words || ' ')""")
def phrase_search(spark, d):
    """All documents that hold the third to eighth word of a benchmark passage one after another."""
    docs, path = _indexed(spark, d)
    words = F.slice(search.terms(F.col("text")), 3, 6)
    found = search.search(spark, path, _queries(spark, d).withColumn("text", F.array_join(words, " ")), k=1_000_000_000, phrase=True)
    return found.select("query_id", "document_id")
