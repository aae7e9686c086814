"""Functions by name give what the column functions give."""

from pyspark.sql import functions as F

from foliospark.functions import mask, sql, validate
from foliospark.operators import jobs

VALUES = [None, "", "a", "(010) 1234-5678", "02 123 4567", "12 345", "123-45", "a@b.co", "a@b", "1234567", "12345678", "가나다라마바사아자"]


def test_equal_to_columns(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    df = spark.createDataFrame([(v, float(i), float(i % 3)) for i, v in enumerate(VALUES)], "v string, a double, b double")
    named = df.selectExpr("check_phone(v)", "check_postal_code(v)", "check_email(v)", "stars(v)", "percent(a, b)")
    v = F.col("v")
    plain = df.select(validate.phone(v), validate.postal_code(v), validate.email(v), mask.stars(v), jobs.percent(F.col("a"), F.col("b")))
    assert [tuple(r) for r in named.collect()] == [tuple(r) for r in plain.collect()]
    assert "Python" not in named._jdf.queryExecution().executedPlan().toString()
