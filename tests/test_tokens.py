"""Signatures and tokens against published vectors."""

import hashlib
import hmac

from pyspark.sql import functions as F

from foliospark.functions import mask

#: The published vectors of the token format.
KEY = b"cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
TOKEN = "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
BROKEN = [
    "gAAAAAAdwJ6xAAECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPAl1-szkFVzXTuGb4hR8AKtwcaX1YdykQUFBQUFBQUFBQQ==",  # incorrect mac
    "gAAAAAAdwJ6xAAECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPA==",  # too short
    "%%%%%%%%%%%%%AECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPAl1-szkFVzXTuGb4hR8AKtwcaX1YdykRtfsH-p1YsUD2Q==",  # invalid base64
    "gAAAAAAdwJ6xAAECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPOm73QeoCk9uGib28Xe5vz6oxq5nmxbx_v7mrfyudzUm",  # payload size no multiple of a block
    "gAAAAAAdwJ6xAAECAwQFBgcICQoLDA0ODz4LEpdELGQAad7aNEHbf-JkLPIpuiYRLQ3RtXatOYREu2FWke6CnJNYIbkuKNqOhw==",  # payload padding
]
FUTURE = "gAAAAAAdwStRAAECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPAnja1xKYyhd-Y6mSkTOyTGJmw2Xc2a6kBd-iX9b_qXQcw=="
EXPIRED = "gAAAAAAdwJ6xAAECAwQFBgcICQoLDA0OD3HkMATM5lFqGaerZ-fWPAl1-szkFVzXTuGb4hR8AKtwcaX1YdykRtfsH-p1YsUD2Q=="


def test_published_vectors(spark):
    one = spark.range(1)
    made = mask.token(F.lit("hello"), KEY, F.lit("1985-10-26 08:20:00"), F.lit(bytes(range(16))))
    now = F.lit("1985-10-26 08:20:01")
    opened = [mask.opened(F.lit(t), KEY, 60, now) for t in (TOKEN, *BROKEN, FUTURE)] + [mask.opened(F.lit(EXPIRED), KEY, 60, F.lit("1985-10-26 08:21:31"))]
    row = one.select(made.alias("made"), *[c.alias(f"c{i}") for i, c in enumerate(opened)]).first()
    assert row["made"] == TOKEN and row["c0"] == "hello" and set(row[2:]) == {None}


def test_round_trip_of_odd_texts(spark):
    texts = ["", "a", "é" * 1000, "x" * 16, None, "line\nline"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("s", mask.token(F.col("t"), KEY))
    rows = df.select("i", "s", mask.opened(F.col("s"), KEY, 3600).alias("back"), mask.opened(F.col("s"), mask.derived_key("x", b"y", 10)).alias("other"), mask.opened(F.col("t"), KEY).alias("none")).collect()
    assert {r["i"]: r["back"] for r in rows} == dict(enumerate(texts)) and all(r["other"] is None and r["none"] is None for r in rows)
    again = df.select("s").where("s is not null").collect()
    assert len({r["s"] for r in again}) == 5


def test_signatures(spark):
    published = "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"  # "Hi There" under twenty bytes 0b
    row = spark.range(1).select(mask.signature(F.lit("Hi There"), b"\x0b" * 20).alias("a"), mask.signature(F.lit("é"), b"k" * 100).alias("b")).first()
    assert row["a"] == published and row["b"] == hmac.new(b"k" * 100, "é".encode(), hashlib.sha256).hexdigest()
