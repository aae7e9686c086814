"""Not-modified revisit resolution for web archive records, in DataFrame functions throughout.

A revisit says that a server answered "not modified". It is joined as of its time to the latest earlier full response
of the same canonical URL; if a validator agrees, the response's headers with the permitted ones of the revisit on top
are the headers of the resolved record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header fields of a not-modified answer that never replace the stored ones.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change a page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=.*)?$"
#: Seconds of a chunk: a URL's captures are ordered chunk by chunk, so a URL that holds most rows is no single task.
CHUNK_S = 86_400


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www prefix, user, default port, fragment, last slash and tracking parameters; the others are sorted.

    Null, empty and relative URLs give null.
    """
    pattern = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\s+$", ""), r"/+$", "")
    given = F.split(F.regexp_replace(F.regexp_extract(url, pattern, 3), r"\s+$", ""), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def header_map(block: Column) -> Column:
    """Header lines as a map from lower-case names; values of a repeated name are joined by ", ". Null gives an empty map."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^\s:]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^\s:]+)", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^\s:]+\s*:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored map with the permitted fields of the fresh one in place of its own."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def header_text(headers: Column) -> Column:
    """A header map as "name: value" lines in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def latest_earlier(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """(url, ts) of revisits with response_id: the response of the URL at the latest strictly earlier ts, of several the greatest id.

    Captures of one URL at one time become one row first; then order within chunks of a day and what earlier
    chunks hand on replace a single sort of all captures of a URL.
    """
    at = responses.groupBy("url", "ts").agg(F.max("record_id").alias("id"))
    asked = revisits.select("url", "ts").distinct().withColumn("id", F.lit(None).cast("long")).withColumn("asked", F.lit(1))
    points = at.withColumn("asked", F.lit(0)).unionByName(asked).groupBy("url", "ts").agg(F.max("id").alias("id"), F.max("asked").alias("asked"))
    points = points.withColumn("chunk", F.floor(F.col("ts") / CHUNK_S))
    chunks = points.groupBy("url", "chunk").agg(F.max(F.when(F.col("id").isNotNull(), F.struct("ts", "id"))).alias("last"))
    handed = chunks.select("url", "chunk", F.expr("max(last) over (partition by url order by chunk rows between unbounded preceding and 1 preceding).id").alias("handed"))
    near = F.expr("last(id, true) over (partition by url, chunk order by ts rows between unbounded preceding and 1 preceding)")
    found = points.withColumn("near", near).where("asked = 1").join(handed, ["url", "chunk"])
    return found.select("url", "ts", F.coalesce("near", "handed").alias("response_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records (record_id long, warc_type "response" or "revisit", url, ts seconds, headers text) to one row per revisit.

    Returns record_id, canonical_url, ts, response_id, verdict, headers (map). Verdicts: resolved; mismatch (the latest
    earlier response carries another entity tag, or, where one of the two has no tag, another modification date);
    no_validator (nothing to compare); no_response (no earlier response); no_key (URL or time missing or unusable).
    headers are merged for resolved rows and the revisit's own otherwise. Entity tags are compared weakly. Repeated
    revisits stay repeated; record_id of responses is taken to be unique, of repeated ones any counts once; records of
    other types and other columns are left out; an empty table gives an empty one.
    """
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), F.lower("warc_type").alias("kind"), canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "headers")
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    responses = rows.where((F.col("kind") == "response") & usable & F.col("record_id").isNotNull())
    revisits = rows.where(F.col("kind") == "revisit").drop("kind")
    asof = latest_earlier(responses, revisits.where(usable))
    known = responses.groupBy(F.col("record_id").alias("response_id")).agg(F.min("headers").alias("stored"))
    # rows without a response get keys of their own, so that their null doesn't gather them in one task
    asked = revisits.join(asof, ["url", "ts"], "left")
    asked = asked.withColumn("key", F.coalesce(F.col("response_id").cast("string"), F.concat(F.lit("none "), F.xxhash64("record_id"))))
    known = known.select(F.col("response_id").cast("string").alias("key"), "stored")
    met = asked.join(known, "key", "left").drop("key")
    met = met.withColumn("stored", header_map(F.col("stored"))).withColumn("fresh", header_map(F.col("headers")))

    def both(name: str) -> tuple[Column, Column]:
        values = [F.nullif(F.regexp_replace(F.try_element_at(F.col(side), F.lit(name)), r"^W/", ""), F.lit("")) for side in ("stored", "fresh")]
        return values[0], values[1]

    tag, own_tag = both("etag")
    date, own_date = both("last-modified")
    verdict = (
        F.when(~usable, "no_key")
        .when(F.col("response_id").isNull(), "no_response")
        .when(tag.isNotNull() & own_tag.isNotNull(), F.when(tag == own_tag, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & own_date.isNotNull(), F.when(date == own_date, "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    met = met.withColumn("verdict", verdict)
    headers = F.when(F.col("verdict") == "resolved", merged_headers(F.col("stored"), F.col("fresh"))).otherwise(F.col("fresh"))
    return met.select("record_id", F.col("url").alias("canonical_url"), "ts", "response_id", "verdict", headers.alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Each page (page_id, url, html) as a full response and a later check of it, by fixed rules on page_id.

    The check of every 11th page is dated before its response; every 7th carries another entity tag, every 5th none.
    """
    n = F.col("page_id")
    ts = 1_600_000_000 + F.pmod(n * 7919, F.lit(8_640_000))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    base = pages.select(n, "url", ts.alias("at"), tag.alias("tag"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    full = F.concat(F.lit("Content-Type: text/html\r\nETag: "), F.col("tag"), F.lit("\r\nLast-Modified: day "), F.floor(F.col("at") / 86_400), F.lit("\r\nContent-Length: "), F.col("size"), F.lit("\r\nCache-Control: max-age=60"))
    own = F.when(n % 5 == 0, F.lit("")).when(n % 7 == 0, F.lit('ETag: "other"\r\n')).otherwise(F.concat(F.lit("ETag: W/"), F.col("tag"), F.lit("\r\n")))
    check = F.concat(own, F.lit("Last-Modified: day "), F.floor(F.col("at") / 86_400), F.lit("\r\nContent-Length: 0\r\nCache-Control: max-age=120\r\nX-Cache: hit"))
    later = F.col("at") + F.when(n % 11 == 0, F.lit(-3600)).otherwise(3600 * (1 + n % 48))
    response = F.struct((2 * n).alias("record_id"), F.lit("response").alias("warc_type"), "url", F.col("at").alias("ts"), full.alias("headers"))
    revisit = F.struct((2 * n + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), "url", later.alias("ts"), check.alias("headers"))
    return base.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", header_text(F.col("headers")))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id AS n, html, url,
         regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) AS p FROM pages),
canon AS (
  SELECT n, html,
         regexp_replace(regexp_replace(lower(p.host), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_replace(p.path, '\s+$', ''), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_replace(p.query, '\s+$', ''), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=.*)?$'))), '&') AS query FROM parts),
base AS (
  SELECT n, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url,
         1600000000 + (n * 7919) % 8640000 AS made, '"' || md5(coalesce(html, '')) || '"' AS tag, strlen(coalesce(html, '')) AS size FROM canon),
revisits AS (
  SELECT 2 * n + 1 AS record_id, url, n, made, tag, made + CASE WHEN n % 11 = 0 THEN -3600 ELSE 3600 * (1 + n % 48) END AS ts FROM base),
responses AS (SELECT url, made, max(n) AS n FROM base WHERE url IS NOT NULL GROUP BY url, made),
met AS (
  SELECT r.*, b.n AS m, b.made AS b_at, b.tag AS b_tag, b.size AS b_size FROM revisits r
  ASOF LEFT JOIN responses e ON r.url = e.url AND r.ts > e.made LEFT JOIN base b ON b.n = e.n),
judged AS (
  SELECT *, CASE WHEN url IS NULL OR ts IS NULL THEN 'no_key' WHEN m IS NULL THEN 'no_response'
      WHEN n % 5 <> 0 THEN CASE WHEN n % 7 <> 0 AND b_tag = tag THEN 'resolved' ELSE 'mismatch' END
      WHEN b_at // 86400 = made // 86400 THEN 'resolved' ELSE 'mismatch' END AS verdict FROM met)
SELECT record_id, url AS canonical_url, ts, 2 * m AS response_id, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || b_size || chr(10) || 'content-type: text/html' || chr(10)
         || 'etag: ' || CASE WHEN n % 5 = 0 THEN b_tag ELSE 'W/' || tag END || chr(10)
       ELSE 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10)
         || CASE WHEN n % 5 = 0 THEN '' WHEN n % 7 = 0 THEN 'etag: "other"' || chr(10) ELSE 'etag: W/' || tag || chr(10) END END
  || 'last-modified: day ' || (made // 86400) || chr(10) || 'x-cache: hit' AS headers
FROM judged
"""
