"""Scalar functions that scripts of rules call, as native columns where Spark has them."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_16(text: Column) -> Column:
    """Middle sixteen digits of the MD5."""
    return F.substring(F.md5(text), 9, 16)


def base64_text(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def unbase64_text(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def unhex_text(digits: Column) -> Column:
    """Text of hexadecimal digits; null if they are none."""
    return F.decode(F.unhex(digits), "UTF-8")


def to_bytes(text: Column, charset: str = "UTF-8") -> Column:
    """Bytes of a text. The JVM encodes Spark's own charsets, Python the others."""
    if charset.upper() in _NATIVE:
        return F.encode(text, charset)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode(charset, "replace") for t in texts.to_pylist()], pa.binary())

    return run(text)


def from_bytes(data: Column, charset: str = "UTF-8") -> Column:
    """Text of bytes; what the charset doesn't have becomes U+FFFD."""
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else bytes(v).decode(charset, "replace") for v in values.to_pylist()], pa.string())

    return run(data)


_NATIVE = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def encode_uri(text: Column) -> Column:
    """Form encoding of a text in UTF-8."""
    return F.url_encode(text)


def time_format_utc(millis: Column, pattern: str, offset: int) -> Column:
    """A time in a zone that is ``offset`` milliseconds from UTC, in Java's pattern."""
    seconds = F.lit(offset // 1000)
    moment = F.timestamp_millis(millis + seconds * 1000)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")), pattern)


def random_uuid() -> Column:
    """A new identifier a row; not the same twice."""
    return F.uuid()


def aes_encrypt(text: Column, key: str, iv: str = "", mode: str = "CBC") -> Column:
    """AES with PKCS padding, in Base64; the initial vector stands in front, as Spark has it."""
    args = [F.encode(text, "UTF-8"), F.lit(key.encode()), F.lit(mode), F.lit("PKCS")] + ([F.lit(iv.encode())] if iv else [])
    return F.base64(F.aes_encrypt(*args))


def aes_decrypt(data: Column, key: str, mode: str = "CBC") -> Column:
    """The text of what ``aes_encrypt`` made."""
    return F.decode(F.aes_decrypt(F.unbase64(data), F.lit(key.encode()), F.lit(mode), F.lit("PKCS")), "UTF-8")


def simplified(text: Column) -> Column:
    """Simplified and traditional characters aren't exchanged: the text as it is."""
    return text


def time_format(millis: Column, pattern: str = "yyyy/MM/dd HH:mm") -> Column:
    return F.date_format(F.timestamp_millis(millis), pattern)


def digest_hex(text: str, algorithm: str) -> str:
    return hashlib.new(algorithm.replace("-", "").lower(), text.encode()).hexdigest()


def hmac_hex(text: str, algorithm: str, key: str) -> str:
    return hmac.new(key.encode(), text.encode(), algorithm.lower().removeprefix("hmac")).hexdigest()


def hmac_base64(text: str, algorithm: str, key: str) -> str:
    return base64.b64encode(hmac.new(key.encode(), text.encode(), algorithm.lower().removeprefix("hmac")).digest()).decode()


def half_width(text: str) -> str:
    """Full-width letters, digits and space as half-width ones."""
    return "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)


# Numerals.
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10**4, "亿": 10**8}


def chinese_number(text: str) -> int:
    """Number of Chinese or Arabic numerals, -1 if it is none."""
    text = re.sub(r"\s+", "", half_width(text))
    if re.fullmatch(r"\d+", text):
        return int(text)
    if not text or any(c not in _DIGITS and c not in _UNITS for c in text):
        return -1
    if len(text) > 1 and all(c in _DIGITS for c in text):
        return int("".join(str(_DIGITS[c]) for c in text))
    total = section = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c]
            continue
        unit = _UNITS[c]
        if unit >= 10**4:
            total = (total + section + digit) * unit if unit == 10**8 else total + (section + digit) * unit
            section = digit = 0
        else:
            section += (digit or 1) * unit
            digit = 0
    return total + section + digit


def chapter_number(title: str) -> str:
    """``第…章`` with its numeral in digits."""
    m = re.match(r"(第)(.+?)(章)", title)
    if m is None or (n := chinese_number(m[2])) < 0:
        return title
    return f"{m[1]}{n}{m[3]}{title[m.end() :]}"
