"""Formatting of extracted texts: native columns where Spark can express them, plain functions for the rest."""

from __future__ import annotations

import html as _html
import re
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INDENT = "　　"

# Fixed values, applied in this order: patterns of markup in a content and what they become.
FORMAT_STEPS = (
    (r"(&nbsp;)+", " "),
    (r"(&ensp;|&emsp;)", " "),
    (r"(&thinsp;|&zwnj;|&zwj;| |‌|‍)", ""),
    (r"</?(?:div|p|br|hr|h\d|article|dd|dl)[^>]*>", "\n"),
    (r"<!--[^>]*-->", ""),
    (r"</?[a-zA-Z]+(?=[ >])[^<>]*>", ""),
    (r"\s*\n+\s*", "\n　　"),
    (r"^[\n\s]+", "　　"),
    (r"[\n\s]+$", ""),
)


def format_html(text: Column, indent: str = INDENT) -> Column:
    """HTML as plain text, paragraphs indented."""
    out = F.coalesce(text, F.lit(""))
    for pattern, value in FORMAT_STEPS:
        out = F.regexp_replace(out, pattern, value.replace(INDENT, indent))
    return out


# White space, digits and letters without case are ASCII ones, as in Java.
_STEPS = [(re.compile(p, re.A), v) for p, v in FORMAT_STEPS]
_MARKUP = FORMAT_STEPS[5][0]
_BUT_IMAGES = re.compile(r"</?(?!img)[a-zA-Z]+(?=[ >])[^<>]*>", re.A)


def format_text(text: str, keep_images: bool = False) -> str:
    """The same for one text; ``keep_images`` leaves image tags in."""
    for pattern, value in _STEPS:
        text = (_BUT_IMAGES if keep_images and pattern.pattern == _MARKUP else pattern).sub(value, text)
    return text


# The four forms of an image's source: with options, in a data attribute, in double quotes, in any quotes.
_IMAGE = re.compile(
    r"""<img[^>]*\ssrc\s*=\s*['"]([^'"{>]*\{(?:[^{}]|\{[^}>]+\})+\})['"][^>]*>"""
    r"""|<img[^>]*\sdata-(?:src|original|srcset)\s*=\s*['"]([^'">]+)['"][^>]*>"""
    r"""|<img[^>]*\ssrc\s*=\s*"([^">]+)"[^>]*>"""
    r"""|<img[^>]*\s(?:data-[^=>]*|src)=\s*['"]([^'">]*)['"][^>]*>""",
    re.I | re.A,
)


def format_keep_images(text: str, base: str) -> str:
    """Plain text in which images stay, as bare tags with absolute sources; options after the source stay with it."""
    from .url import absolute, split_option

    def one(m: re.Match) -> str:
        url, option = split_option(m[1]) if m[1] is not None else (next((g for g in m.groups()[1:] if g is not None), ""), None)
        return f'<img src="{absolute(base, url)}{"," + option if option else ""}">'

    return _IMAGE.sub(one, format_text(text, keep_images=True))


#: Beginnings of introductions that stay as they are.
_PLAIN_INTRO = r"^\s*(?:<usehtml>|<md>|<useweb>)"


def format_intro(text: Column) -> Column:
    """An introduction as plain text without indents, unless it says that it is markup."""
    return F.when(text.rlike(_PLAIN_INTRO), F.regexp_replace(text, r"^\s+", "")).otherwise(format_html(text, ""))


# Fixed value: a word count in the note beside a chapter.
WORDS_IN_NOTE = r"(?:^|字数[：:、]?|\s+)([0-9万千百\.]{1,6}字)"


def words_of_note(note: Column) -> tuple[Column, Column]:
    """The word count in a chapter's note, null if there is none, and the note without it."""
    found, whole = F.regexp_extract(note, WORDS_IN_NOTE, 1), F.regexp_extract(note, WORDS_IN_NOTE, 0)
    at = F.instr(note, whole)
    rest = F.concat(F.substring(note, F.lit(1), at - 1), F.substring(note, at + F.length(whole), F.length(note)))
    return F.nullif(F.trim(found), F.lit("")), F.when(found == "", note).otherwise(rest)


# Author parts of titles, and labels of authors.
NAME_TAIL = r"\s+作\s*者.*|\s+\S+\s+著"
AUTHOR_LABEL = r"^\s*作\s*者[:：\s]+|\s+著"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def clean_name(name: Column) -> Column:
    """Title without an author part."""
    return _trim(F.regexp_replace(name, NAME_TAIL, ""))


def clean_author(author: Column) -> Column:
    return _trim(F.regexp_replace(author, AUTHOR_LABEL, ""))


def word_count(n: Column) -> Column:
    """Word counts: above 10000 in ten-thousands with one decimal, rounded half to even."""
    wan = F.bround(n / F.lit(10000.0), 1)
    text = F.when(wan == F.floor(wan), F.format_string("%d", wan.cast("long"))).otherwise(F.format_string("%.1f", wan))
    return F.when(n.isNull() | (n <= 0), F.lit("")).when(n > 10000, F.concat(text, F.lit("万字"))).otherwise(F.concat(n.cast("string"), F.lit("字")))


def word_count_of(text: Column) -> Column:
    """The same for a text: what isn't a whole number stays, a blank is empty."""
    n = F.trim(text).try_cast("bigint")
    whole = F.trim(text).rlike(r"^[+-]?\d+$") & n.isNotNull()
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit("")).when(whole, word_count(n)).otherwise(text)


def word_count_text(value: str | None) -> str:
    """The same for a text; what isn't a whole number stays."""
    if value is None or not value.strip():
        return ""
    if not re.fullmatch(r"[+-]?\d+", value.strip()):
        return value
    n = int(value)
    if n <= 0:
        return ""
    if n <= 10000:
        return f"{n}字"
    wan = (Decimal(n) / 10000).quantize(Decimal("0.1"), ROUND_HALF_EVEN)
    return f"{wan.normalize():f}万字"


def is_true(value: str | None) -> bool:
    """Whether a rule's text means yes."""
    return bool(value and value.strip()) and value.strip().lower() not in ("null", "false", "no", "not", "0", "0.0")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def title_line(title: Column) -> Column:
    return F.regexp_replace(title, r"[\r\n]+", "")


def unescape(text: str) -> str:
    """HTML 4 entities that end in a semicolon, and numeric ones."""
    def one(m: re.Match) -> str:
        if m[0] == "&apos;":
            return m[0]
        value = _html.unescape(m[0])
        return value if value != m[0] else m[0]

    return re.sub(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", one, text)
