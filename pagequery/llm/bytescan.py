"""Vectorised scanning of UTF-8 text in numpy: word spans, word hashes and hashes of word n-grams.

Works on the data buffer of an Arrow string column, in slices of bounded size, so no Python string is
made for a document and memory doesn't depend on how many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text makes a slice of its own.
SLICE = 1 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_NGRAM = np.uint64(0xD6E8FEB86659FD93)


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves the rest."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(allowed) -> np.ndarray:
    """Byte table of word members; bytes of multi-byte characters always belong to words."""
    t = np.zeros(256, dtype=bool)
    t[128:] = True
    for b in range(128):
        t[b] = allowed(b)
    return t


LOWER = lower_table()
#: Words `[^\x20\x09-\x0D]+`.
SPACED = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def slices(ids: pa.Array, texts: pa.Array, size: int = SLICE) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Row ids (as they are, nulls too), bytes and offsets (one more than rows, from 0) of consecutive rows; null texts count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield ids.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and first word of each document (one more than documents)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def last_of_doc(self) -> np.ndarray:
        """For every word the index after the last word of its document."""
        return np.repeat(self.first[1:], self.count)


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes in ``table``; no run crosses the bounds of a document. ``data`` is lower-cased already."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offs), dtype=np.int64))
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    p, q = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * q[start])
    return Words(start, end, h, np.searchsorted(start, offs))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (length: words - k + 1, none below 0); caller drops those that cross documents."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for j in range(1, k):
        out = out * _NGRAM + h[j : j + m]
    return mix(out + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
