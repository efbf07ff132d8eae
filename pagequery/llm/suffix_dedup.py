"""Repeated long byte strings, found with a run-compressed Burrows-Wheeler index.

1. Every window of ``length`` bytes has an anchor: the k-gram of smallest hash inside it. Windows in a row with the same anchor make
   a segment. Equal windows have equal anchors, so only segments whose anchor occurs twice can hold a repeated window.
2. Of equal segments two occurrences go on, and stand for the others; that folds copies of whole documents.
3. Segments are dealt to tasks by anchor. Each task sorts the suffixes of its segments, keeps the transform as runs with
   the suffixes sampled at both ends of each run, and streams matching statistics over the text: the longest match of every position with any other
   one follows from the samples alone, since it shrinks by one a byte between them. A window of which the match is
   as long as itself is repeated.
4. Spans go back to all occurrences of a segment, and are united by document.

An anchor with more than ``MANY`` different segments (a passage in very many contexts) isn't gathered in a task: its windows are
counted by 128-bit hash instead, in an aggregation that folds in the map tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import mix, powers, slices, sliding_min
from .shared import SEND, cut, forget, unique_ids

#: Bytes of an anchor.
K = 32
#: Occurrences of an anchor's different segments that one task may hold: about 280 bytes each, and 50 times that while they are sorted.
MANY = 8_000
#: An anchor is hot that more than this share of all segments have; so there are fewer than its inverse.
HOT = 1e-3
#: Bytes of segments in a task's index, on average.
INDEX = 1 << 20
#: Ends a segment in an index; no byte of UTF-8.
STOP = 0xFF


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers of the slice's polynomial hash."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return total, q


def segments(data: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each segment of a slice: document, first byte in the slice, length, hash of the anchor and of the segment's bytes."""
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total, q = _hash(data)
    grams = mix((total[k:] - total[:-k]) * q[: n - k + 1])
    bits = np.uint64(max(20, int(n).bit_length()))
    keyed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keyed, length - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows inside one document only.
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(at)]
    inside = np.arange(len(at)) + length <= offs[1:][doc]
    starts = np.flatnonzero(inside)
    at, doc = at[starts], doc[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, dtype=np.int64)
    last = np.append(new[1:], len(at)) - 1
    begin, end = starts[new], starts[last] + length
    size = end - begin
    return doc[new], begin, size, grams[at[new]], mix((total[end] - total[begin]) * q[begin] + size.astype(np.uint64))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes' first ``depth`` bytes or more (equal ones in any order), by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key).astype(np.int32)  # the wide places are gone at once
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    # A suffix's rank is the place of the first one that is equal so far.
    places = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(new, places, np.int32(0)))
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = head
    h = 8
    while h < depth:
        todo = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        if not len(todo):
            break
        pos = sa[todo]
        key = head[todo].astype(np.uint64)
        key <<= np.uint64(32)
        key |= np.where(pos + np.int32(h) < n, rank[np.minimum(pos + np.int32(h), n - 1)] + np.int32(1), np.int32(0)).astype(np.uint64)
        order = np.argsort(key)
        sa[todo] = pos[order]
        key = key[order]
        del pos, order
        new[todo] = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        # Only places with company change their rank; the first of their equals is among them.
        head[todo] = np.maximum.accumulate(np.where(new[todo], todo, np.int32(0)))
        rank[sa[todo]] = head[todo]
        h *= 2
    return sa


class RunIndex:
    """Burrows-Wheeler transform in runs, with the suffix and its match length at both ends of every run."""

    def __init__(self, text: np.ndarray, longest: int):
        self.n = n = len(text)
        sa = suffix_array(text, longest + 1)
        bwt = text[sa - 1]
        # Every stop counts as a letter of its own, so that no match runs across it.
        head = np.ones(n, dtype=bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == STOP)
        head |= sa == 0
        head[1:] |= sa[:-1] == 0
        begin = np.flatnonzero(head)
        self.letters, self.lengths = bwt[begin], np.diff(np.append(begin, n))
        last = (np.cumsum(self.lengths) - 1).astype(np.int32)
        first = begin.astype(np.int32)
        del head, begin, bwt
        self.head_at, self.tail_at = sa[first], sa[last]
        self.head_match = self._match(text, sa[np.maximum(first - 1, 0)], sa[first], first > 0)
        self.tail_match = self._match(text, sa[last], sa[np.minimum(last + 1, n - 1)], last < n - 1)

    @staticmethod
    def _match(text: np.ndarray, a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Bytes that two suffixes share, up to a stop."""
        out = np.zeros(len(a), dtype=np.int32)
        todo = np.flatnonzero(there)
        # Eight bytes at a time; the text ends with a stop, and what is read beyond it is none of a match.
        padded = np.concatenate([text, np.full(8, STOP, dtype=np.uint8)])
        wide = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        for part in range(0, len(todo), 1 << 16):
            some = todo[part : part + (1 << 16)]
            while len(some):
                s, t = wide[a[some] + out[some]], wide[b[some] + out[some]]
                k = np.minimum(_first_byte(s ^ t), _first_byte(_zeros(~s)))
                out[some] += k
                some = some[k == 8]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with another position, from the samples in text order."""
        reach = np.zeros(self.n, dtype=np.int32)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            reach[at] = np.maximum(reach[at], at + match)  # between samples a match ends where it did
        np.maximum.accumulate(reach, out=reach)
        return reach - np.arange(self.n, dtype=np.int32)


def _zeros(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is zero, and of none before the first such one."""
    return (x - np.uint64(0x0101010101010101)) & ~x & np.uint64(0x8080808080808080)


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Number of the lowest byte that isn't zero, 8 if all are."""
    low = x & (~x + np.uint64(1))
    return (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)


def repeated(parts: list[bytes], length: int, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans covered by windows of ``length`` bytes that also start elsewhere in any of the strings: the string's number, first byte and end, in order.
    ``sure``: strings known to occur once more, as a whole."""
    stop = bytes([STOP])
    text = np.frombuffer(stop.join(parts) + stop, dtype=np.uint8)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    marked = RunIndex(text, int(size.max())).matching_statistics() >= length
    if sure is not None:
        edge = np.zeros(len(text) + 1, dtype=np.int8)
        edge[begin[sure]] = 1
        edge[begin[sure] + size[sure] - length + 1] = -1
        marked |= np.cumsum(edge[:-1], dtype=np.int8) > 0
    change = np.flatnonzero(np.diff(marked, prepend=False, append=False))
    first, end = change[::2], change[1::2] - 1 + length
    # Runs of windows that cover one span are put together; ends grow with the starts.
    owner = np.searchsorted(begin, first, side="right") - 1
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] > end[:-1])]) if len(first) else np.zeros(0, dtype=bool)
    last = np.append(np.flatnonzero(new)[1:], len(first)) - 1 if len(first) else np.zeros(0, dtype=np.int64)
    owner = owner[new]
    return owner, first[new] - begin[owner], end[last] - begin[owner]


_SEG = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("size", pa.int32()), ("id", pa.int64()), ("at", pa.int32())])


def _segments_kernel(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1), 1 << 19):
                doc, begin, size, anchor, seg = segments(data, offs, length, k)
                arrays = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(size.astype(np.int32)), ids.take(pa.array(doc)), pa.array((begin - offs[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, schema=_SEG)

    return run


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of a document's segments."""
    for batch in batches:
        for text, segs in zip(*batch.columns, strict=True):
            data = memoryview((text.as_py() or "").encode())
            s = segs.values
            spans = zip(s.field("at").to_pylist(), s.field("size").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([s.field("anchor"), s.field("seg"), s.field("which"), pa.array([data[a : a + n] for a, n in spans], pa.binary())], names=["anchor", "seg", "which", "bytes"])


_MARKS = "anchor long, seg long, spans array<struct<a:int,b:int>>"


def _index_kernel(length: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["which"].to_numpy(), group["seg"].to_numpy(), group["anchor"].to_numpy()))
        found = group["bytes"].take(pa.array(order)).to_pylist()
        which, rows = group["which"].to_numpy()[order], order
        # A second occurrence that is byte for byte the same matches in full: it needn't be in the index. One that isn't (its hashes alone are the same) is.
        same = np.zeros(len(found), dtype=bool)
        for i in np.flatnonzero(which).tolist():
            same[i] = found[i] == found[i - 1]
        kept = np.flatnonzero(~same)
        sure = np.append(same[1:], False)[kept]
        part, a, b = repeated([found[i] for i in kept.tolist()], length, sure)
        del found
        pa.default_memory_pool().release_unused()
        own = which[kept][part] == 0
        part, a, b = part[own], a[own], b[own]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        rows = pa.array(rows[kept][part[first]])
        spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["a", "b"]))
        return pa.table({"anchor": group["anchor"].take(rows), "seg": group["seg"].take(rows), "spans": spans})

    return run


def _windows_kernel(length: int):
    """Windows of segments as 128-bit hashes, for anchors with too many segments to index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for anchor, seg, which, data in zip(*batch.columns, strict=True):
                data = memoryview(data.as_buffer())
                m = len(data) - length + 1
                hashes = [xxh3_128_digest(data[a : a + length]) for a in range(m)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, anchor.as_py()), pa.int64()), pa.array(np.full(m, seg.as_py()), pa.int64()), pa.array(np.full(m, which.as_py()), pa.int32()),
                    pa.array(np.arange(m), pa.int32()), pa.array(hashes, pa.binary()),
                ], names=["anchor", "seg", "which", "w", "h"])

    return run


def _final_kernel(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, spans in zip(*batch.columns, strict=True):
                data = (text.as_py() or "").encode()
                merged: list[tuple[int, int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                    else:
                        merged.append(s)
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((i.as_py(), len(data), [{"a": a, "b": b} for a, b in merged], kept.hexdigest()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(cols[3])], names=["id", "n_bytes", "spans", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``spans`` (byte ranges covered by strings of ``length`` bytes that also start elsewhere, apart and in order) and
    ``kept_sha256`` of the bytes that are left.

    Texts are UTF-8; null ones are empty and, like those shorter than ``length``, have no spans. Rows that repeat, share an id or have a null one are documents of their own,
    and count as copies of each other where their texts are equal. An empty table gives no rows. Other columns are ignored.
    """
    k = min(K, max(1, length // 4))
    slim, own = unique_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")))
    every = cut(slim.mapInArrow(_segments_kernel(length, k), "anchor long, seg long, size int, id long, at int"), "segments")
    # Anchors are counted in an aggregation that folds in the map tasks. Rows of hot ones then find them in a list of bounded size, the others in a join.
    twice = cut(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    hot = F.broadcast(twice.where(F.col("n") > HOT * every.count()).select("anchor"))
    usual = every.join(hot, "anchor", "left_anti").join(twice.select("anchor"), "anchor", "left_semi")
    found = cut(every.join(hot, "anchor", "left_semi").unionByName(usual), "segments")
    forget(every)
    place = F.struct("id", "at", "size")
    distinct = found.groupBy("anchor", "seg").agg(F.min(place).alias("x"), F.max(place).alias("y"))
    distinct = distinct.select("anchor", "seg", F.posexplode(F.array_distinct(F.array("x", "y"))).alias("which", "p"))
    distinct = cut(distinct.select("anchor", "seg", "which", "p.id", "p.at", "p.size"), "distinct")
    volume = distinct.agg(F.sum("size")).first()[0] or 0
    crowded = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select("anchor"), "crowded")
    crowds = not crowded.isEmpty()

    by_doc = distinct.groupBy("id").agg(F.collect_list(F.struct("anchor", "seg", "which", "at", "size")).alias("segs"))
    ids = cut(distinct.select("id").distinct(), "ids")
    texts = slim.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= SEND else slim
    parts = by_doc.join(texts, "id").select("t", "segs").mapInArrow(_cut_kernel, "anchor long, seg long, which int, bytes binary")
    if crowds:
        parts = cut(parts, "parts")
        plain = parts.join(crowded, "anchor", "left_anti")
    else:
        plain = parts
    tasks = max(1, -(-volume // INDEX))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(tasks))
    marks = plain.groupBy(bucket.alias("bucket")).applyInArrow(_index_kernel(length), _MARKS)
    if crowds:
        windows = parts.join(crowded, "anchor", "left_semi").mapInArrow(_windows_kernel(length), "anchor long, seg long, which int, w int, h binary")
        windows = cut(windows, "windows")
        again = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        marked = windows.where("which = 0").join(again, "h").groupBy("anchor", "seg").agg(F.array_sort(F.collect_set("w")).alias("w"))
        span = F.transform("w", lambda w: F.struct(w.alias("a"), (w + length).cast("int").alias("b")))
        marks = marks.unionByName(marked.select("anchor", "seg", span.alias("spans")))
    marks = cut(marks, "marks")

    spans = found.join(marks, ["anchor", "seg"]).select("id", F.explode(F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))).alias("s"))
    spans = spans.groupBy("id").agg(F.collect_list("s").alias("spans"))
    final = slim.join(spans, "id", "left").select("id", "t", "spans")
    out = final.mapInArrow(_final_kernel(length), "id long, n_bytes long, spans array<struct<a:long,b:long>>, kept_sha256 string")
    if own is not None:
        out = out.join(own, "id").select(F.col("own").alias("id"), "n_bytes", "spans", "kept_sha256")
    return out.withColumnRenamed("id", id_col)
