"""Functions against worked examples and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import extract, mask, normalize, text, validate


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    given = ["계약일 2025 년 6 월 1 일\n금액 1 0 0 원\x07 2025-06-01 12", " a　 b\x0b\x1cc​d ", "", None, "1 2 3 4"]
    assert values(spark, text.normalize, *given) == ["계약일 2025년 6월 1일 금액 100 원 2025-06-0112", " a b c​d ", "", None, "1234"]
    assert values(spark, lambda c: text.normalize(c, False), "1 2") == ["1 2"]
    assert values(spark, text.strip, " 　x y\x85 ", "   ") == ["x y", ""]


def test_white_space_is_unicode(spark):
    sample = "".join(chr(i) for i in range(1, 0x3001) if not 0xD800 <= i < 0xE000)
    assert values(spark, text.collapse, sample) == [re.sub(r"\s+", " ", sample)]


@pytest.mark.parametrize(("f", "pairs"), [
    (normalize.date, {"2025 년 6월 1일": "2025-06-01", "계약일 2025/6/1 까지": "2025-06-01", "2025.13.45": "2025-13-45", "2025-6-1": "2025-6-1", None: None}),
    (normalize.phone, {"010-1234-5678": "010-1234-5678", "(011) 234-5678": "011-234-5678", "02-123-4567": "021234567", "02-1234-5678": "021-234-5678", "+82-10-1234-5678": "+821012345678", "none": ""}),
    (normalize.amount, {"100,000원": "100,000", "₩ 1,234.5": "1,234.50", "1,234.567": "1,234.57", "1.2.3": "1.2.3", "없음": "없음", "-500": "500"}),
    (normalize.road_address, {"서울시   테헤란로 12 3층": "서울시 테헤란로 12", "서울시 강남구 테헤란로 123": "서울시 강남구 테헤란로 123"}),
    (normalize.strict_phone, {"010 1234 5678": "010-1234-5678", "02-123-4567": "02-123-4567", "123": None}),
    (normalize.postal_code, {"12345": "12345", "1234": None}),
    (normalize.extension, {"a/b.PDF": "pdf", ".bashrc": "", "x.": "", "a.tar.gz": "gz"}),
    (normalize.mime_type, {"a.hwp": "application/x-hwp", "a.unknown": "application/octet-stream"}),
    (normalize.safe_name, {"../a/b\\c": "_a_b_c"}),
    (validate.resident_id, {"900101-1234568": None, "900101-1234567": "checksum", "9001011234568": None, "abc": "format", None: "format"}),
    (validate.business_id, {"123-45-67895": None, "1234567890": "checksum", "12": "format"}),
    (validate.password, {"short": "too_short", "longenough": "upper", "LONGENOUGH": "lower", "LongEnough": "digit", "LongEnough1": "special", "LongEnough1!": None}),
    (validate.api_key, {"abc": "too_short", "abcdefghijklmnop": None, "abcdefghijklmno p": "characters"}),
    (validate.email, {"a@b.co": None, "a@b": "email", None: "email"}),
    (validate.file_type, {"a.pdf": None, "a.exe": "file_type"}),
    (lambda c: validate.number(c, 1, 5), {"3": None, "0": "too_small", "9": "too_large", "x": "number"}),
    (lambda c: validate.length(c, 2, 3), {"a": "too_short", "ab": None, "abcd": "too_long"}),
    (lambda c: mask.whole(c, ".+"), {"901010-1234567": "901*******4567", "1234567": "123****", "12345678": "123*5678"}),
    (lambda c: mask.within(c, r"\d{8}"), {"a 12345678 b 11112222": "a 123*5678 b 111*2222", "none": "none"}),
    (extract.person_name, {"이름 : 홍길동 외": "홍길동", "name": None}),
    (lambda c: F.array_join(extract.dates(c), "|"), {"2025-01-02, 2024 년 3월 4 일 2025/05/06": "2024년 3월 4일|2025년 01월 02일|2025년 05월 06일"}),
    (lambda c: F.array_join(F.transform(extract.amounts(c), lambda a: F.concat_ws(" ", a["value"].cast("string"), a["currency"])), "|"), {"1,000원 2,000 원 $3.5 ,원 $1.2.3": "1000.0 KRW|2000.0 KRW|3.5 USD"}),
    (extract.fenced_json, {'x ```json {"a":1} ``` y': '{"a":1}', '{"b":2}': '{"b":2}', "[1]": '{"raw_text":"[1]"}', "plain": '{"raw_text":"plain"}'}),
    (lambda c: normalize.parsed_date(c).cast("string"), {"2025년 2월 3일": "2025-02-03", "2025.2.3": "2025-02-03", "2025-2-30": None, "x": None}),
    (lambda c: normalize.by_field(F.lit("update_x"), c), {" 2025/1/2 ": "2025-01-02"}),
    (lambda c: normalize.by_field(F.lit("hotel"), c), {"010-1234-5678": "010-1234-5678"}),
])
def test_examples(spark, f, pairs):
    assert values(spark, f, *pairs) == list(pairs.values())


def test_password_hash(spark):
    df = spark.createDataFrame([("pw", "00ff")], "p string, s string")
    hashed = mask.password_hash(df.p, df.s)
    assert df.select(mask.password_fits(df.p, hashed), mask.password_fits(F.lit("other"), hashed)).first()[:] == (True, False)


def test_signature(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("body é",)], "m string")
    for key in (b"k", b"long" * 40):
        assert df.select(mask.signature(df.m, key)).first()[0] == hmac.new(key, "body é".encode(), hashlib.sha256).hexdigest()
