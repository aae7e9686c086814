"""Registered query that calls the library's functions from a SQL text. It has SQL that gives the same rows."""

from __future__ import annotations

from foliospark.functions import sql
from foliospark.plans.registry import query
from foliospark.sources.files import table


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'phone' END AS phone, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'postal_code' END AS postal, 'email' AS email,
  substr(c_name, 1, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS hidden, CASE WHEN c_nationkey > 0 THEN c_custkey / c_nationkey * 100 ELSE 0 END::DOUBLE AS share FROM customer""")
def functions_in_sql(spark, d):
    sql.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("named_customers")
    return spark.sql("""SELECT c_custkey, check_phone(if(c_custkey % 2 = 0, '(010) 1234 5678', 'x')) AS phone, check_postal_code(if(c_custkey % 3 = 0, '1 2345', '12')) AS postal, check_email(c_name) AS email,
      stars(c_name) AS hidden, percent(c_custkey, c_nationkey) AS share FROM named_customers""")
