"""Tables in the roles that the operators expect: as they are, or derived by rule where no table has such values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.files import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a list of documents."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("uploaded_by"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("upload_date"))


def eav(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.concat(F.year("o_orderdate"), F.lit("년 "), F.month("o_orderdate"), F.lit("월 "), F.day("o_orderdate"), F.lit("일"))
    rows = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("field_value")) for n, v in {
        "contract_date": day,
        "contact_phone": F.concat(F.lit("010"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")),
        "total_amount": F.concat(F.floor("o_totalprice").cast("string"), F.lit("원")),
        "ship_address": F.concat(F.lit("서울시   테헤란로 "), F.col("o_orderkey") % 100, F.lit(" 3층")),
        "summary": F.when(F.col("o_orderkey") % 5 == 0, "   ").otherwise(F.concat(F.lit("order "), F.col("o_orderstatus"))),
    }.items()])
    return o.select(F.col("o_orderkey").alias("document_id"), F.explode(rows).alias("r")).select("document_id", "r.*")


EAV_SQL = """
b AS (SELECT o_orderkey AS document_id, year(o_orderdate)::VARCHAR || '년 ' || month(o_orderdate)::VARCHAR || '월 ' || day(o_orderdate)::VARCHAR || '일' AS kdate,
    '010' || lpad(o_custkey::VARCHAR, 8, '0') AS phone, floor(o_totalprice)::BIGINT::VARCHAR || '원' AS amt,
    '서울시   테헤란로 ' || (o_orderkey % 100)::VARCHAR || ' 3층' AS addr,
    CASE WHEN o_orderkey % 5 = 0 THEN '   ' ELSE 'order ' || o_orderstatus END AS summary FROM orders),
eav AS (SELECT document_id, 'contract_date' AS field_name, kdate AS field_value FROM b UNION ALL SELECT document_id, 'contact_phone', phone FROM b
    UNION ALL SELECT document_id, 'total_amount', amt FROM b UNION ALL SELECT document_id, 'ship_address', addr FROM b UNION ALL SELECT document_id, 'summary', summary FROM b)
"""


def ids(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    resident = F.concat(two(F.year("o_orderdate") % 100), two(F.month("o_orderdate")), two(F.day("o_orderdate")), F.lit("-"), 1 + k % 4, F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"))
    return o.select(k, resident.alias("resident_id"), F.lpad((k * 104729 % 10000000000).cast("string"), 10, "0").alias("business_id"))


IDS_SQL = """
ids AS (SELECT o_orderkey, lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || lpad(month(o_orderdate)::VARCHAR, 2, '0') || lpad(day(o_orderdate)::VARCHAR, 2, '0')
    || '-' || (1 + o_orderkey % 4)::VARCHAR || lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS resident_id,
    lpad((o_orderkey * 104729 % 10000000000)::VARCHAR, 10, '0') AS business_id FROM orders)
"""


def korean_texts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    whole = F.floor("o_totalprice").cast("string")
    text = F.concat(
        F.lit("이름 : 홍길동 계약일 "), F.year("o_orderdate"), F.lit(" 년 "), F.month("o_orderdate"), F.lit(" 월 "), F.day("o_orderdate"), F.lit(" 일, 납기 "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 주소: 서울시 중구 세종로 "), F.col("o_orderkey") % 90, F.lit(" 금액 "), whole, F.lit(" 원 ($"), whole, F.lit(".5)"),
    )
    return o.select(F.col("o_orderkey").alias("document_id"), text.alias("text"))


KOREAN_SQL = """
korean AS (SELECT o_orderkey AS document_id, o_orderdate AS d, o_orderkey % 90 AS house, floor(o_totalprice)::BIGINT AS whole, '이름 : 홍길동 계약일 ' || year(o_orderdate) || ' 년 '
    || month(o_orderdate) || ' 월 ' || day(o_orderdate) || ' 일, 납기 ' || strftime(o_orderdate, '%Y-%m-%d') || ' 주소: 서울시 중구 세종로 ' || (o_orderkey % 90)
    || ' 금액 ' || floor(o_totalprice)::BIGINT || ' 원 ($' || floor(o_totalprice)::BIGINT || '.5)' AS text FROM orders)
"""


def user_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    roles = F.array_compact(F.array(F.lit("user"), F.when(k % 7 == 0, "admin"), F.when(k % 3 == 0, "auditor")))
    return table(spark, d, "customer").select(k.alias("user_id"), F.explode(roles).alias("role_name"))


ROLES_SQL = """
user_roles AS (SELECT c_custkey AS user_id, r.role_name FROM customer, (VALUES ('user', 1), ('admin', 7), ('auditor', 3)) r(role_name, k) WHERE c_custkey % r.k = 0),
permissions AS (SELECT role_name, unnest(p) AS permission FROM (VALUES
    ('user', ['document.upload', 'document.view', 'document.process', 'document.export', 'document.delete_own']),
    ('admin', ['document.upload', 'document.view', 'document.process', 'document.export', 'document.delete_own', 'document.delete_any', 'user.manage', 'settings.manage', 'api.manage']),
    ('auditor', ['document.view', 'document.export', 'audit.view', 'report.generate'])) t(role_name, p))
"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as results of batches: one batch per user, errors are failures."""
    return table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("document_id"), F.col("ts").alias("completed_at"), (F.col("event_type") != "error").alias("success"))


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("job_type"), F.col("ts").alias("created_at"), F.col("event_id").alias("job_id"), "value")


def pages_of_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text", (F.col("turn") % 10 / 10).alias("confidence"))
