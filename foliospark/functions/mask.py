"""Masking, hashing, signing and encryption."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-value patterns of identifiers.
RESIDENT, BUSINESS = r"\d{6}-?[1-4]\d{6}", r"\d{3}-?\d{2}-?\d{5}"


def stars(match: Column) -> Column:
    """Over seven characters the first three and last four stay, otherwise the first half."""
    n = F.length(match)
    half = F.floor(n / 2).cast("int")
    return F.when(n > 7, F.concat(F.substr(match, F.lit(1), F.lit(3)), F.repeat(F.lit("*"), n - 7), F.substr(match, n - 3, F.lit(4)))).otherwise(F.concat(F.substr(match, F.lit(1), half), F.repeat(F.lit("*"), n - half)))


def whole(value: Column, pattern: str) -> Column:
    """Masked where the whole value fits."""
    return F.when(value.rlike(f"^(?:{pattern})$"), stars(value)).otherwise(value)


def within(text: Column, pattern: str) -> Column:
    """Every match within a text masked."""
    parts = F.split(text, pattern, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), stars), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(parts, found, lambda a, b: F.array(a, b))), "")


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def password_hash(password: Column, salt_hex: Column) -> Column:
    """hex(salt)$sha256(salt and password)."""
    return F.concat(salt_hex, F.lit("$"), F.sha2(F.concat(F.unhex(salt_hex), password.cast("binary")), 256))


def password_fits(password: Column, stored: Column) -> Column:
    return password_hash(password, F.substring_index(stored, "$", 1)) == stored


def signature(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a message in hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


#: Fixed values of the token format: its first byte, and how far a clock may run ahead in seconds.
_VERSION, _AHEAD = b"\x80", 60


def derived_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """The 32 bytes of a key from a password (PBKDF2, SHA-256), base64 for URLs; once, on the driver."""
    return base64.urlsafe_b64encode(hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32))


def _keys(key: bytes) -> tuple[bytes, bytes]:
    """The halves of a key that sign and that encrypt."""
    raw = base64.urlsafe_b64decode(key)
    if len(raw) != 32:
        raise ValueError("a key is 32 bytes, base64 for URLs")
    return raw[:16], raw[16:]


def _url_safe(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def token(text: Column, key: bytes, at: Column | None = None, iv: Column | None = None) -> Column:
    """An encrypted token of a text: version, time, IV, AES-CBC ciphertext and an HMAC over them, base64 for URLs. Null stays null.

    at: when it was made (now if not given). iv: 16 bytes, random if not given; given ones have to differ from row to
    row, else equal texts show. All of it runs as column functions; the key is part of the plan, as with any literal.
    """
    signing, secret = _keys(key)
    seconds = F.unix_timestamp() if at is None else F.unix_timestamp(at.cast("timestamp"))
    time = F.unhex(F.lpad(F.hex(seconds), 16, "0"))
    sealed = F.aes_encrypt(text.cast("binary"), F.lit(secret), F.lit("CBC"), F.lit("PKCS"), *([iv] if iv is not None else []))  # the IV stands in front
    signed = F.concat(F.lit(_VERSION), time, sealed)
    return _url_safe(F.concat(signed, F.unhex(signature(signed, signing))))


def opened(sealed: Column, key: bytes, most_seconds: int | None = None, now: Column | None = None) -> Column:
    """The text of a token; null where it is broken, altered, made with another key, from the future, or older than most_seconds."""
    signing, secret = _keys(key)
    fits = sealed.rlike(r"^[A-Za-z0-9_-]+={0,2}$") & (F.length(sealed) % 4 == 0) & (F.length(sealed) >= 100)
    raw = F.when(fits, F.try_to_binary(F.translate(sealed, "-_", "+/"), F.lit("base64")))
    n = F.length(raw)
    signed = F.substr(raw, F.lit(1), n - 32)
    whole = (F.substr(raw, F.lit(1), F.lit(1)) == F.lit(_VERSION)) & (F.hex(F.substr(raw, n - 31, F.lit(32))) == F.upper(signature(signed, signing)))
    made = F.conv(F.hex(F.substr(raw, F.lit(2), F.lit(8))), 16, 10).cast("long")
    present = F.unix_timestamp() if now is None else F.unix_timestamp(now.cast("timestamp"))
    if most_seconds is not None:  # without a limit the time isn't looked at
        whole = whole & (made + most_seconds >= present) & (made <= present + _AHEAD)
    return F.when(F.coalesce(whole, F.lit(False)), F.try_aes_decrypt(F.substr(signed, F.lit(10), n - 41), F.lit(secret), F.lit("CBC"), F.lit("PKCS")).cast("string"))
