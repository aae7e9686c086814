"""Functions of this library by name, for SQL texts.

They are SQL functions, so a query that calls them is planned as if their bodies stood there: nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliospark.functions.extract import PHONE


def _check(code: str, fits: str) -> str:
    return f"CASE WHEN coalesce({fits}, false) THEN NULL ELSE '{code}' END"


#: Name: (parameters, type, body). Each gives what the column function of the same purpose gives.
FUNCTIONS = {
    "check_phone": ("value STRING", "STRING", _check("phone", rf"regexp_replace(value, r'[\s\p{{Z}}\-()]', '') RLIKE r'^{PHONE}$'")),
    "check_postal_code": ("value STRING", "STRING", _check("postal_code", r"regexp_replace(value, r'[\s\p{Z}]', '') RLIKE r'^\d{5}$'")),
    "check_email": ("value STRING", "STRING", _check("email", r"value RLIKE r'^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$'")),
    "stars": ("value STRING", "STRING", "CASE WHEN length(value) > 7 THEN substr(value, 1, 3) || repeat('*', length(value) - 7) || substr(value, length(value) - 3) ELSE substr(value, 1, length(value) DIV 2) || repeat('*', length(value) - length(value) DIV 2) END"),
    "percent": ("part DOUBLE, whole DOUBLE", "DOUBLE", "CASE WHEN whole > 0 THEN part / whole * 100 ELSE 0D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session and returns their names; those of the same names are replaced."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
