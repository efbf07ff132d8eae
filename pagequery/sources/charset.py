"""Bytes to text: byte-order mark, declared charset, ``<meta>``, then a guess."""

from __future__ import annotations

import codecs
import re

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_\-:.]+)""", re.I)


def meta_charset(data: bytes) -> str | None:
    """Charset that the head of an HTML document declares."""
    lower = data.lower()
    a = lower.find(b"<head")
    b = lower.find(b"</head>", a + 1)
    window = data[a : b if b >= 0 else a + 4096] if a >= 0 else data[:1024]
    m = _META.search(window)
    return m[1].decode("ascii") if m else None


def detect(data: bytes) -> str:
    """A charset in which the bytes make sense; UTF-8 for plain ASCII."""
    if data[:3] == codecs.BOM_UTF8:
        return "UTF-8"
    if data[:2] == codecs.BOM_UTF16_BE:
        return "UTF-16BE"
    if data[:2] == codecs.BOM_UTF16_LE:
        return "UTF-16LE"
    try:
        data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    best, name = -1.0, "ISO-8859-1"
    for codec, label in (("gb18030", "GB18030"), ("big5", "Big5"), ("shift_jis", "Shift_JIS"), ("euc_jp", "EUC-JP"), ("euc_kr", "EUC-KR")):
        text = data.decode(codec, "replace")
        bad = text.count("�")
        common = sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힣" for c in text)
        score = (common - 20 * bad) / max(len(text), 1)
        if score > best and common:
            best, name = score, label
    return name


def decode(data: bytes, content_type: str | None = None) -> str:
    """Text of a response; malformed bytes become U+FFFD. A charset in ``<meta>`` that doesn't exist is an error."""
    if len(data) > 3 and data[:3] == codecs.BOM_UTF8:
        return data[3:].decode("utf-8", "replace")
    if content_type and (m := re.search(r"charset\s*=\s*[\"']?([\w\-]+)", content_type, re.I)):
        try:
            return data.decode(m[1], "replace")
        except LookupError:
            pass
    if (name := meta_charset(data)) is not None:
        return data.decode({"gb2312": "gb18030", "gbk": "gb18030"}.get(name.lower(), name), "replace")
    return data.decode({"GB18030": "gb18030"}.get(detect(data), detect(data)), "replace")
