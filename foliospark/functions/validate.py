"""Validation: each function gives the code of the first rule that a value breaks, null if it breaks none. Null values are broken unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.extract import PHONE
from foliospark.functions.normalize import MIME, extension

#: Weights of the two check digits.
RESIDENT_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)


def _rule(code: str, fits: Column) -> Column:
    return F.when(~F.coalesce(fits, F.lit(False)), F.lit(code))


def file_type(name: Column, allowed: tuple = tuple(MIME)) -> Column:
    return _rule("file_type", extension(name).isin(*allowed))


def file_size(size: Column, most: int = 100 * 1024 * 1024) -> Column:
    return _rule("file_size", size <= most)


#: What a client lets through before an upload, narrower than the server's rules.
CLIENT_TYPES, CLIENT_SIZE = ("pdf", "jpg", "jpeg", "png", "tiff", "bmp", "doc", "docx"), 10 * 1024 * 1024


def upload(name: Column, size: Column) -> Column:
    """The client's check: the part after the last dot, then the size."""
    return F.coalesce(_rule("file_type", F.lower(F.substring_index(name, ".", -1)).isin(*CLIENT_TYPES)), _rule("file_size", size <= CLIENT_SIZE))


def api_key(value: Column) -> Column:
    return F.coalesce(_rule("too_short", F.length(value) >= 16), _rule("characters", value.rlike(r"^[a-zA-Z0-9_\-.]+$")))


def email(value: Column) -> Column:
    return _rule("email", value.rlike(r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"))


def password(value: Column) -> Column:
    return F.coalesce(
        _rule("too_short", F.length(value) >= 8),
        _rule("upper", value.rlike("[A-Z]")),
        _rule("lower", value.rlike("[a-z]")),
        _rule("digit", value.rlike(r"\d")),
        _rule("special", value.rlike(r"[!@#$%^&*(),.?\":{}|<>]")),
    )


def _without(value: Column, signs: str = "") -> Column:
    """The value without white space and these signs: people write them where they like."""
    return F.regexp_replace(value, rf"[\s\p{{Z}}{signs}]", "")


def phone(value: Column) -> Column:
    """Blanks, dashes and brackets don't count."""
    return _rule("phone", _without(value, "\\-()").rlike(f"^{PHONE}$"))


def postal_code(value: Column) -> Column:
    """Blanks don't count."""
    return _rule("postal_code", _without(value).rlike(r"^\d{5}$"))


def _weighted(digits: Column, weights: tuple) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).try_cast("int") * w
    return total


def resident_id(value: Column) -> Column:
    """Blanks and dashes don't count."""
    digits = _without(value, "\\-")
    check = (11 - _weighted(digits, RESIDENT_WEIGHTS) % 11) % 10
    return F.coalesce(_rule("format", digits.rlike(r"^\d{6}[1-4]\d{6}$")), _rule("checksum", check == F.substring(digits, 13, 1).try_cast("int")))


def business_id(value: Column) -> Column:
    """Blanks and dashes don't count."""
    digits = _without(value, "\\-")
    check = (10 - _weighted(digits, BUSINESS_WEIGHTS) % 10) % 10
    return F.coalesce(_rule("format", digits.rlike(r"^\d{10}$")), _rule("checksum", check == F.substring(digits, 10, 1).try_cast("int")))


def missing_fields(fields: Column, required: list[str]) -> Column:
    """Required names that a map lacks or holds null for, in their order."""
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: F.try_element_at(fields, r).isNull())


def length(value: Column, least: int | None = None, most: int | None = None) -> Column:
    return F.coalesce(_rule("too_short", F.length(value) >= F.lit(least or 0)), _rule("too_long", F.length(value) <= F.lit(most) if most is not None else value.isNotNull()))


def number(value: Column, least: float | None = None, most: float | None = None) -> Column:
    n = value.try_cast("double")
    return F.coalesce(_rule("number", n.isNotNull()), _rule("too_small", n >= least) if least is not None else F.lit(None), _rule("too_large", n <= most) if most is not None else F.lit(None))
