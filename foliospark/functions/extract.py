"""Entity extraction as column expressions; every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import BLANKS, WS, strip

#: Patterns whose matches define the results.
NAME = rf"이{WS}*름{WS}*(?::|{WS}){WS}*([가-힣]{{2,5}})"
ADDRESS = rf"주{WS}*소{WS}*(?::|{WS}){WS}*([가-힣0-9,\-{BLANKS}]+[동로길]{WS}*[0-9-]+)"
PHONE = r"(01[016789]|02|0[3-9]\d{1})-?(\d{3,4})-?(\d{4})"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DATE_KOREAN = rf"(\d{{4}}){WS}*년{WS}*(\d{{1,2}}){WS}*월{WS}*(\d{{1,2}}){WS}*일"
DATE_ISO = r"(\d{4})-(\d{2})-(\d{2})"
DATE_SLASH = r"(\d{4})/(\d{2})/(\d{2})"
WON = rf"([\d,]+){WS}*원"
DOLLAR = rf"\${WS}*([\d,.]+)"


def from_start(characters: str, pattern: str) -> str:
    """A pattern that begins with a run of characters, tried only where such a run begins or the last match ended.

    The matches are the same, since what fails at the beginning of a run fails within it as well; but the time no longer
    grows with the square of a run's length.
    """
    return rf"(?:\G|(?<!{characters})){pattern}"


_EMAIL = from_start("[a-zA-Z0-9._%+-]", r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
_WON = from_start(r"[\d,]", rf"([\d,]++){WS}*원")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def person_name(text: Column) -> Column:
    return first_match(text, NAME)


def address(text: Column) -> Column:
    return strip(first_match(text, ADDRESS))


def emails(text: Column) -> Column:
    return all_matches(text, _EMAIL)


def phones(text: Column, anchored: bool = True) -> Column:
    """Phone numbers; anchored: only where the whole text is one."""
    return all_matches(text, f"^{PHONE}$" if anchored else PHONE)


def dates(text: Column) -> Column:
    """Dates in Korean wording: first the Korean ones, then ISO, then with slashes; repeats stay, numbers lose leading zeros only in the Korean ones' source."""

    def worded(pattern: str) -> Column:
        return F.transform(all_matches(text, pattern), lambda m: F.concat(*[part for i, unit in ((1, "년 "), (2, "월 "), (3, "일")) for part in (F.regexp_extract(m, pattern, i), F.lit(unit))]))

    return F.concat(worded(DATE_KOREAN), worded(DATE_ISO), worded(DATE_SLASH))


def amounts(text: Column) -> Column:
    """Array of (value double, currency, text): won first, then dollars; what isn't a number is left out."""

    def found(pattern: str, currency: str, kind: str) -> Column:
        def one(m: Column) -> Column:
            digits = F.replace(F.regexp_extract(m, pattern, 1), F.lit(","))
            return F.struct(digits.try_cast(kind).cast("double").alias("value"), F.lit(currency).alias("currency"), m.alias("text"))

        return F.filter(F.transform(all_matches(text, pattern), one), lambda x: x["value"].isNotNull())

    return F.concat(found(_WON, "KRW", "decimal(38,0)"), found(DOLLAR, "USD", "double"))


def structured(text: Column, anchored: bool = True) -> Column:
    """All entities of a text in one struct; empty categories are null."""

    def some(array: Column) -> Column:
        """Null for an empty array; its patterns stand once in the plan, which a condition on the array beside it would double."""
        return F.get(F.filter(F.array(array), lambda a: F.size(a) > 0), F.lit(0))

    return F.struct(
        person_name(text).alias("name"), some(phones(text, anchored)).alias("phones"), some(emails(text)).alias("emails"),
        address(text).alias("address"), some(dates(text)).alias("dates"), some(amounts(text)).alias("amounts"),
    )


def fenced_json(reply: Column) -> Column:
    """JSON text of a model's reply: what a json fence holds, else the reply; replies that hold no object give {"raw_text": reply}."""
    inner = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1), F.lit("")), reply)
    parsed = F.try_parse_json(inner)
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), inner).when(reply.isNotNull(), F.to_json(F.struct(reply.alias("raw_text"))))


def recognized(reply: Column) -> Column:
    """(text, confidence) of an image model's reply: its JSON, in a fence or bare, with 0.9 where it names no confidence; any other reply is the text itself with 0.8."""
    inner = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), reply)
    parsed = F.from_json(inner, "extracted_text string, confidence double")
    good = parsed["extracted_text"].isNotNull()
    return F.struct(F.when(good, parsed["extracted_text"]).otherwise(reply).alias("text"), F.when(good, F.coalesce(parsed["confidence"], F.lit(0.9))).otherwise(0.8).alias("confidence"))
