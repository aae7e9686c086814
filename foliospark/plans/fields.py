"""Registered queries over fields and values: checks, formats, entities, structured data. Each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import extract, mask, normalize, validate
from foliospark.operators import catalog, eav, pages, prompts
from foliospark.plans import inputs as I
from foliospark.plans.registry import query
from foliospark.sinks import export
from foliospark.sources.files import table

#: SQL: the parts of orders as files, phones, postal codes and numbers.
_FORMS = """forms AS (SELECT o_orderkey AS k, 'scan ' || o_orderkey || '.' || ['pdf', 'JPG', 'bmp', 'exe', 'hwp', 'docx'][(o_orderkey % 6)::INT + 1] AS name, (o_orderkey * 7919) % 200000000 AS size,
  CASE o_orderkey % 4 WHEN 0 THEN '010-1234-5678' WHEN 1 THEN '0212345678' WHEN 2 THEN '02-123-45678' ELSE 'none' END AS phone, CASE o_orderkey % 3 WHEN 0 THEN '12345' WHEN 1 THEN '1234' ELSE '123-45' END AS postal,
  CASE o_orderkey % 5 WHEN 0 THEN 'x' ELSE ((o_orderkey % 100) - 20)::VARCHAR END AS number, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS maybe, o_orderpriority AS prio FROM orders)"""


def _forms(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (k % n + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("k"), F.concat(F.lit("scan "), k, F.lit("."), pick(6, "pdf", "JPG", "bmp", "exe", "hwp", "docx")).alias("name"), (k * 7919 % 200000000).alias("size"), pick(4, "010-1234-5678", "0212345678", "02-123-45678", "none").alias("phone"),
        pick(3, "12345", "1234", "123-45").alias("postal"), F.when(k % 5 == 0, "x").otherwise((k % 100 - 20).cast("string")).alias("number"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("maybe"), F.col("o_orderpriority").alias("prio"),
    )


@query(f"""WITH {_FORMS}, e AS (SELECT *, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM forms) SELECT k,
  CASE WHEN ext NOT IN ('pdf', 'jpg', 'hwp', 'docx') THEN 'file_type' END AS file_type, CASE WHEN size > 104857600 THEN 'file_size' END AS file_size,
  CASE WHEN ext NOT IN ('pdf', 'jpg', 'bmp', 'docx') THEN 'file_type' WHEN size > 10485760 THEN 'file_size' END AS upload,
  CASE WHEN phone = 'none' THEN 'phone' END AS phone, CASE WHEN postal <> '12345' THEN 'postal_code' END AS postal,
  CASE WHEN number = 'x' THEN 'number' WHEN number::INT < 0 THEN 'too_small' WHEN number::INT > 50 THEN 'too_large' END AS number, CASE WHEN length(prio) < 6 THEN 'too_short' WHEN length(prio) > 10 THEN 'too_long' END AS length,
  CASE WHEN maybe IS NULL THEN 'maybe' ELSE '' END AS missing FROM e""")
def validate_forms(spark, d):
    """Every rule for files, uploads, phones, postal codes, numbers, lengths and required fields."""
    c = F.col
    fields = F.create_map(F.lit("name"), c("name"), F.lit("maybe"), c("maybe"))
    return _forms(spark, d).select(
        "k", validate.file_type(c("name")).alias("file_type"), validate.file_size(c("size")).alias("file_size"), validate.upload(c("name"), c("size")).alias("upload"), validate.phone(c("phone")).alias("phone"),
        validate.postal_code(c("postal")).alias("postal"), validate.number(c("number"), 0, 50).alias("number"), validate.length(c("prio"), 6, 10).alias("length"), F.array_join(validate.missing_fields(fields, ["name", "maybe"]), ",").alias("missing"),
    )


_SPACED = """SELECT o_orderkey AS k, ['(010) 1234-5678', '010 1234 5678', '02)123-4567', '010_1234_5678', ' 0 1 0-12345678 '][(o_orderkey % 5)::INT + 1] AS phone, ['123 45', ' 1 2 3 4 5 ', '123-45', '1234 '][(o_orderkey % 4)::INT + 1] AS postal,
  substr(n, 1, 3) || [' ', '-', ' - ', '', '_'][(o_orderkey % 5)::INT + 1] || substr(n, 4, 2) || [' ', '-', '  '][(o_orderkey % 3)::INT + 1] || substr(n, 6) AS business, substr(r, 1, 6) || [' ', ' - ', '--', '/'][(o_orderkey % 4)::INT + 1] || substr(r, 7) AS resident, n, r
  FROM (SELECT o_orderkey, lpad((o_orderkey * 104729 % 10000000000)::VARCHAR, 10, '0') AS n, lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') || (1 + o_orderkey % 5) || lpad((o_orderkey * 331 % 1000000)::VARCHAR, 6, '0') AS r FROM orders)"""


@query(f"""WITH s AS ({_SPACED}), b AS (SELECT *, (list_sum(list_transform(list_zip(string_split(substr(n, 1, 9), ''), [1, 3, 7, 1, 3, 7, 1, 3, 5]), lambda z: z[1]::INT * z[2])))::INT AS bs,
  (list_sum(list_transform(list_zip(string_split(substr(r, 1, 12), ''), [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]), lambda z: z[1]::INT * z[2])))::INT AS rs FROM s)
  SELECT k, CASE WHEN k % 5 = 3 THEN 'phone' END AS phone, CASE WHEN k % 4 > 1 THEN 'postal_code' END AS postal,
  CASE WHEN contains(business, '_') THEN 'format' WHEN (10 - bs % 10) % 10 <> substr(n, 10)::INT THEN 'checksum' END AS business,
  CASE WHEN contains(resident, '/') OR substr(r, 7, 1) = '5' THEN 'format' WHEN (11 - rs % 11) % 10 <> substr(r, 13)::INT THEN 'checksum' END AS resident FROM b""")
def validate_spaced(spark, d):
    """Phones, postal codes and numbers of people and businesses as they are written, with blanks, dashes and brackets in odd places."""
    k = F.col("o_orderkey")
    pick = lambda *options: F.element_at(F.array(*[F.lit(o) for o in options]), (k % len(options) + 1).cast("int"))
    n = F.lpad((k * 104729 % 10000000000).cast("string"), 10, "0")
    r = F.concat(F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), 1 + k % 5, F.lpad((k * 331 % 1000000).cast("string"), 6, "0"))
    business = F.concat(F.substring(n, 1, 3), pick(" ", "-", " - ", "", "_"), F.substring(n, 4, 2), pick(" ", "-", "  "), F.substring(n, 6, 9))
    return table(spark, d, "orders").select(
        k.alias("k"), validate.phone(pick("(010) 1234-5678", "010 1234 5678", "02)123-4567", "010_1234_5678", " 0 1 0-12345678 ")).alias("phone"), validate.postal_code(pick("123 45", " 1 2 3 4 5 ", "123-45", "1234 ")).alias("postal"),
        validate.business_id(business).alias("business"), validate.resident_id(F.concat(F.substring(r, 1, 6), pick(" ", " - ", "--", "/"), F.substring(r, 7, 9))).alias("resident"),
    )


@query(f"""WITH {_FORMS} SELECT k, CASE phone WHEN '010-1234-5678' THEN phone WHEN '0212345678' THEN '02-1234-5678' WHEN '02-123-45678' THEN '02-1234-5678' END AS phone, CASE postal WHEN '12345' THEN postal WHEN '123-45' THEN '12345' END AS postal,
  CASE maybe WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE maybe END AS label, '_a_' || replace(name, '..', '') AS safe, prio IN ('1-URGENT') AS urgent, size::VARCHAR IN ('1') AS flag FROM forms""")
def format_values(spark, d):
    c = F.col
    return _forms(spark, d).select(
        "k", normalize.strict_phone(c("phone")).alias("phone"), normalize.postal_code(c("postal")).alias("postal"), normalize.status_label(c("maybe"), {"f": "done", "o": "open"}).alias("label"),
        normalize.safe_name(F.concat(F.lit("../a/"), c("name"))).alias("safe"), normalize.flag(F.when(c("prio") == "1-URGENT", "Yes").otherwise("no")).alias("urgent"), normalize.flag(c("size").cast("string")).alias("flag"),
    )


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(01[016789]|02|0[3-9]\d{1})-?(\d{3,4})-?(\d{4})'), lambda x: true) AS phones, regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS emails,
  list_transform(regexp_extract_all(coalesce(text, ''), '(\d{4})-(\d{2})-(\d{2})'), lambda x: x[1:4] || '년 ' || x[6:7] || '월 ' || x[9:10] || '일') AS dates FROM documents""")
def extract_structured(spark, d):
    """All entities of whole texts; empty categories come as empty lists."""
    found = table(spark, d, "documents").select("doc_id", extract.structured(F.coalesce("text", F.lit("")), False).alias("e"))
    some = lambda c: F.coalesce(F.col(f"e.{c}"), F.array().cast("array<string>"))
    return found.select("doc_id", some("phones").alias("phones"), some("emails").alias("emails"), some("dates").alias("dates"))


@query(f"""WITH {I.KOREAN_SQL} SELECT document_id, unnest(['full_text', 'personal_info_name', 'personal_info_address', 'dates_1', 'dates_2', 'amounts_1_value', 'amounts_1_currency', 'amounts_1_text', 'amounts_2_value', 'amounts_2_currency', 'amounts_2_text']) AS field_name,
  unnest([text, '홍길동', '서울시 중구 세종로 ' || house, year(d) || '년 ' || month(d) || '월 ' || day(d) || '일', strftime(d, '%Y년 %m월 %d일'), whole::VARCHAR, 'KRW', whole || ' 원', whole || '.5', 'USD', '$' || whole || '.5']) AS field_value FROM korean""")
def shred_korean(spark, d):
    """Names, addresses, dates and amounts of Korean texts as rows, beside the texts."""
    docs = I.korean_texts(spark, d).withColumn("confidence", F.lit(0.5)).withColumn("entities", extract.structured(F.col("text"), False))
    return eav.shred(docs).select("document_id", "field_name", "field_value")


_STRUCTURED = """s AS (SELECT document_id, CASE WHEN field_name <> 'summary' THEN split_part(field_name, '_', 1) END AS group_name, CASE WHEN field_name = 'summary' THEN field_name ELSE substr(field_name, strpos(field_name, '_') + 1) END AS field, field_value AS value FROM eav)"""


@query(f"""WITH {I.EAV_SQL}, {_STRUCTURED} SELECT document_id, group_name, field, CASE field WHEN 'date' THEN regexp_extract(value, '(\\d+)년', 1) || '-' || lpad(regexp_extract(value, '(\\d+)월', 1), 2, '0') || '-' || lpad(regexp_extract(value, '(\\d+)일', 1), 2, '0')
  WHEN 'phone' THEN substr(value, 1, 3) || '-' || substr(value, 4, 4) || '-' || substr(value, 8) WHEN 'amount' THEN format('{{:,}}', replace(value, '원', '')::BIGINT) WHEN 'address' THEN '서울시 테헤란로 ' || regexp_extract(value, '로 (\\d+)', 1) ELSE trim(value) END AS value
  FROM s WHERE trim(value) <> ''""")
def process_documents(spark, d):
    """Structure, normalise, prune as one."""
    return eav.processed(I.eav(spark, d))


@query(f"""WITH {I.EAV_SQL}, {_STRUCTURED} SELECT c_custkey AS document_id, CASE WHEN n IS NULL THEN '{eav.NO_DATA}' END AS message, price, summary FROM customer
  LEFT JOIN (SELECT document_id, count(*) AS n, max(value) FILTER (group_name = 'total' AND field = 'amount') AS price, max(value) FILTER (group_name IS NULL AND field = 'summary') AS summary FROM s GROUP BY document_id) USING (document_id)""".replace("FROM customer", "FROM (SELECT *, c_custkey AS document_id FROM customer)").replace("c_custkey AS document_id, CASE", "document_id, CASE"))
def read_views(spark, d):
    """Customers as documents: those whose number is an order's have data."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    view = eav.read_view(docs, I.eav(spark, d))
    return view.select("document_id", "message", eav.looked_up(F.col("groups"), "total.amount").alias("price"), F.try_element_at("singles", F.lit("summary")).alias("summary"))


@query(f"WITH {I.EAV_SQL} SELECT document_id, field_name FROM eav WHERE field_name <> 'summary' AND document_id % 10 / 10.0 >= 0.5")
def confident_fields(spark, d):
    """Shown fields of at least half confidence."""
    rows = I.eav(spark, d).withColumn("confidence", F.col("document_id") % 10 / 10)
    return eav.confident(eav.displayed(rows, ("summary",)), 0.5).select("document_id", "field_name")


@query(f"WITH {I.EAV_SQL}, {_STRUCTURED} SELECT document_id, list_sort(list_distinct(list(coalesce(group_name, field)))) AS fields FROM s WHERE trim(value) <> '' GROUP BY document_id")
def field_lists(spark, d):
    return eav.field_names(eav.pruned(eav.structure(I.eav(spark, d))))


@query("SELECT user_id AS document_id, event_type AS field_name, arg_min(value::VARCHAR, (ts, value::VARCHAR)) AS field_value FROM (SELECT user_id, event_type, ts, event_id::VARCHAR AS value FROM events) GROUP BY ALL")
def first_values(spark, d):
    rows = I.job_events(spark, d).select("document_id", F.col("job_type").alias("field_name"), F.col("job_id").cast("string").alias("field_value"), "created_at")
    return eav.first_values(rows, "created_at")


@query("""SELECT event_id, key AS name, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) WHERE json_type(props, '$.' || key) NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def scalar_members(spark, d):
    return eav.scalar_members(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "name", "value")


@query("""SELECT o_orderkey AS document_id, 'k' AS field_name, o_orderpriority AS field_value FROM orders UNION ALL SELECT o_orderkey, 'summary', 'order of ' || o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'category', o_orderstatus FROM orders WHERE o_orderkey % 3 = 0""")
def shred_replies(spark, d):
    """Replies of a language model by task as rows."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    fenced = F.concat(F.lit("Sure: ```json {\"k\": \""), F.col("o_orderpriority"), F.lit("\", \"list\": [1]} ``` done"))
    made = lambda task, reply: F.struct(F.lit(task).alias("task"), reply.alias("reply"))
    tasks = F.array_compact(F.array(made("extraction", extract.fenced_json(fenced)), F.when(k % 2 == 0, made("summary", F.concat(F.lit("order of "), F.col("o_custkey")))), F.when(k % 3 == 0, made("classification", F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")))), made("qa", F.lit("x"))))
    return eav.shred_reply(o.select(k.alias("document_id"), F.explode(tasks).alias("t")).select("document_id", "t.*")).select("document_id", "field_name", "field_value")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'page ' || o_orderkey WHEN 1 THEN 'plain ' || o_orderkey ELSE 'bare ' || o_orderkey END AS text, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM orders""")
def recognized_pages(spark, d):
    """Replies of an image model: fenced JSON, plain text, bare JSON without a confidence."""
    k = F.col("o_orderkey")
    reply = F.when(k % 3 == 0, F.concat(F.lit('```json {"extracted_text": "page '), k, F.lit('", "confidence": 0.5} ```'))).when(k % 3 == 1, F.concat(F.lit("plain "), k)).otherwise(F.concat(F.lit('{"extracted_text": "bare '), k, F.lit('"}')))
    return table(spark, d, "orders").select("o_orderkey", extract.recognized(reply).alias("r")).select("o_orderkey", "r.text", "r.confidence")


@query("""SELECT o_orderkey, CASE WHEN n > 0 THEN round(total / n, 6) ELSE 0 END::DOUBLE AS confidence, n::INT AS boxes FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_linenumber % 3 <> 0) AS n, sum(l_quantity) FILTER (l_linenumber % 3 <> 0) / 100 AS total FROM lineitem GROUP BY 1)""")
def page_confidence(spark, d):
    """Lines of an order as the words of a page; every third has no confidence."""
    box = F.struct(F.lit("w").alias("text"), F.when(F.col("l_linenumber") % 3 == 0, -1.0).otherwise(F.col("l_quantity").cast("double")).alias("conf"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(box).alias("boxes"))
    return p.select("o_orderkey", F.round(pages.word_confidence(F.col("boxes")), 6).alias("confidence"), F.size(pages.real_boxes(F.col("boxes"))).alias("boxes"))


@query("""SELECT conv_id AS document_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS text_hash, max(role) FILTER (turn = 0 OR turn = 1) IS NOT NULL AS started FROM conversations GROUP BY conv_id""")
def synced_documents(spark, d):
    c = table(spark, d, "conversations")
    docs = c.groupBy(F.col("conv_id").alias("document_id")).agg(F.max(F.col("turn").isin(0, 1) & F.col("role").isNotNull()).alias("started"))
    return pages.synced(I.pages_of_conversations(spark, d), docs, ("started",)).select("document_id", F.md5("text").alias("text_hash"), "started")


@query("""SELECT c_custkey AS "customer.id", c_name AS "customer.name", c_mktsegment AS "customer.market.segment", [c_custkey, c_nationkey] AS codes FROM customer""")
def flatten_nested(spark, d):
    c = table(spark, d, "customer")
    nested = c.select(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("market")).alias("customer"), F.array("c_custkey", F.col("c_nationkey").cast("long")).alias("codes"))
    return export.flattened(nested)


@query(f"""WITH {I.EAV_SQL} SELECT document_id, '[' || string_agg('{{"field":"' || field_name || '","value":"' || field_value || '"}}', ',' ORDER BY field_name) || ']' AS json FROM eav GROUP BY document_id""")
def export_json(spark, d):
    return export.json_array(export.pairs(I.eav(spark, d)))


@query("SELECT o_orderkey AS document_id, o_orderstatus AS status FROM orders")
def export_projection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return catalog.projected(o, {"status": True, "priority": False})


_PADS = ["".join(f"\\x{x ^ pad:02X}" for x in b"webhook-key".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""SELECT doc_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(coalesce(text, ''))))) AS signature, CASE WHEN lang = 'en' THEN 2 WHEN lang IS NULL THEN 0 ELSE 1 END::INT AS fields, doc_id % 2 = 0 AS fits FROM documents""")
def signatures(spark, d):
    """Signatures of texts, the number of a template's fields, and whether passwords (of odd documents a wrong one) fit their hashes."""
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    vars_ = F.when(F.col("lang") == "en", F.array(F.lit("a"), F.lit("b"))).when(F.col("lang").isNotNull(), F.array(F.lit("a")))
    given = F.concat("t", F.when(F.col("doc_id") % 2 == 0, "").otherwise("!"))
    return docs.select("doc_id", mask.signature(F.col("t"), b"webhook-key").alias("signature"), prompts.field_count(vars_).cast("int").alias("fields"), mask.password_fits(given, mask.password_hash(F.col("t"), F.lit("00ff"))).alias("fits"))


@query("""SELECT c_custkey AS document_id, 'personal_info' AS category, 'phones' AS field, 2 AS item, 'x' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 'amounts', 'value', 1, c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'dates', NULL, 3, c_name FROM customer""")
def reassembled(spark, d):
    c = table(spark, d, "customer")
    row = lambda n, v: F.struct(F.lit(n).alias("field_name"), v.cast("string").alias("field_value"))
    rows = F.array(row("personal_info_phones_2", F.concat(F.lit("x"), F.col("c_custkey"))), row("amounts_1_value", F.col("c_nationkey")), row("dates_3", F.col("c_name")), row("summary", F.lit("s")))
    return eav.reassemble(c.select(F.col("c_custkey").alias("document_id"), F.explode(rows).alias("r")).select("document_id", "r.*"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def at_paths(spark, d):
    return table(spark, d, "events").select("event_id", eav.at_path(F.col("props"), "k").alias("k"))


@query("""SELECT doc_id, md5(text) AS opened, 4 * ((57 + 16 * (strlen(text) // 16 + 1) + 2) // 3) AS size, NULL::VARCHAR AS altered, NULL::VARCHAR AS expired, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS in_time FROM documents""")
def sealed_texts(spark, d):
    """Texts as encrypted tokens, opened again; altered and expired ones don't open."""
    key = mask.derived_key("pass phrase", b"0123456789abcdef", 1000)
    made = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("doc_id") % 2 == 0, 90).otherwise(0))
    docs = table(spark, d, "documents").select("doc_id", mask.token(F.col("text"), key, made, F.unhex(F.md5(F.col("doc_id").cast("string")))).alias("token"))
    altered = F.concat(F.expr("substr(token, 1, 40)"), F.when(F.expr("substr(token, 41, 1)") == "A", "B").otherwise("A"), F.expr("substr(token, 42)"))
    now = F.timestamp_seconds(F.lit(1_700_000_100))
    return docs.select(
        "doc_id", F.md5(mask.opened(F.col("token"), key)).alias("opened"), F.length("token").cast("long").alias("size"), mask.opened(altered, key).alias("altered"),
        mask.opened(F.col("token"), key, 5, now).alias("expired"), F.md5(mask.opened(F.col("token"), key, 60, now)).alias("in_time"),
    )
