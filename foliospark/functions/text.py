"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text tools see it; Java's \s is ASCII only.
BLANKS = r" \t\n\r\f\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{BLANKS}]"


def collapse(text: Column) -> Column:
    """Each run of white space, line ends included, becomes one blank."""
    return F.regexp_replace(text, f"{WS}+", " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def drop_controls(text: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def join_date_parts(text: Column) -> Column:
    """Korean dates with blanks inside, in compact form."""
    w = f"{WS}*"
    return F.regexp_replace(text, rf"(?<!\d)(\d++){w}년{w}(\d++){w}월{w}(\d++){w}일", "$1년 $2월 $3일")


def join_digits(text: Column) -> Column:
    """Digits with only white space between them are joined, neighbouring numbers too."""
    return F.regexp_replace(text, rf"(?<=\d){WS}+(?=\d)", "")


def normalize(text: Column, korean: bool = True) -> Column:
    """Collapse, drop controls and, for Korean text, compact dates and digits. Null stays null."""
    plain = drop_controls(collapse(text))
    return join_digits(join_date_parts(plain)) if korean else plain
