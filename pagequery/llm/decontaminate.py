"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words; of each run of ``window - k + 1`` consecutive k-grams the one with the smallest hash
(the first of equals) is selected, with its place. A span of ``window`` words that both sides hold thus gives both the same fingerprint at the same place in
it. Selected fingerprints of documents are joined with those of the benchmark; each pair of places is extended to the words before and after it, as
far as a window around the fingerprint reaches, and the words are compared byte by byte. Spans of ``window`` words or more are hits.

The benchmark side travels to the workers in blocks of bounded size (``BLOCK`` words). Where there are several, the fingerprints of all go first and leave the documents that
have one of them; each block is then a pass over those, and the hits are put together by document. Documents are never joined with each other, and a
passage that is in every document costs each of them a few look-ups only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import ALNUM, LOWER, Words, grams, slices, sliding_min, words
from .shared import cut

#: Benchmark words in a block: about 40 bytes a word in each worker.
BLOCK = 1_000_000
#: Words of a k-gram.
K = 5
#: Most fingerprints that are sent to find the texts that any of several blocks could hit, at 8 bytes each.
PRINTS = 1 << 23
#: Pairs of places that are extended at once.
PAIRS = 1 << 14


def select(h: np.ndarray, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams selected in the windows of ``size`` words that begin at ``starts``."""
    k = min(K, size)
    g = grams(h, k)
    low = np.uint64(0xFFFFFFFF)  # upper half: hash; lower half: place; so both sides break ties alike
    at = (sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), size - k + 1)[starts] & low).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # windows in a row select the same place
    return at, g[at]


class Index:
    """Words of a block of benchmark items, and the places of their fingerprints by window size."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        raw, first, names = [], [0], {}
        hashes, bounds = [], [0]
        for name, text in items:
            data = LOWER[np.frombuffer(text, dtype=np.uint8)]
            w = words(data, np.array([0, len(data)]), ALNUM)
            if not len(w.hash):
                continue
            whole = data.tobytes()
            spelled = [whole[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            key = tuple(spelled)
            if key in names:  # items of the same words are one
                names[key].append(name)
                continue
            names[key] = [name]
            raw += spelled
            hashes.append(w.hash)
            first.append(first[-1] + len(spelled))
        self.names = list(names.values())
        self.raw, self.first = raw, np.array(first)
        self.hash = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.sizes: dict[int, dict[str, np.ndarray]] = {}
        count = np.diff(self.first)
        for size in sorted(set(np.minimum(count, window).tolist())):
            at, prints = [], []
            for a, n in zip(self.first[:-1][np.minimum(count, window) == size].tolist(), count[np.minimum(count, window) == size].tolist(), strict=True):
                p, g = select(self.hash[a : a + n], size, np.arange(n - size + 1))
                at.append(a + p)
                prints.append(g)
            at, prints = np.concatenate(at), np.concatenate(prints)
            order = np.argsort(prints, kind="stable")
            marks = np.zeros(1 << 20, dtype=bool)
            marks[prints & np.uint64(0xFFFFF)] = True
            self.sizes[size] = {"at": at[order], "prints": prints[order], "marks": marks}

    def hits(self, data: np.ndarray, w: Words) -> Iterator[tuple[int, int, int]]:
        """First word and end of every span shared with an item (parts of one that is longer than two windows come apart), and the item's number."""
        begin, stop = np.repeat(w.first[:-1], w.count), w.last_of_doc()
        raw = None
        for size, x in self.sizes.items():
            k = min(K, size)
            starts = np.flatnonzero(np.arange(len(w.hash)) + size <= stop)
            if not len(starts):
                continue
            at, g = select(w.hash, size, starts)
            near = x["marks"][g & np.uint64(0xFFFFF)]
            at, g = at[near], g[near]
            lo, hi = np.searchsorted(x["prints"], g), np.searchsorted(x["prints"], g, side="right")
            at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            raw = data.tobytes() if raw is None else raw
            after = np.cumsum(many)
            for a in range(0, int(after[-1]), PAIRS):
                pair = np.arange(a, min(a + PAIRS, int(after[-1])))
                row = np.searchsorted(after, pair, side="right")
                p, q = at[row], x["at"][lo[row] + pair - (after[row] - many[row])]
                item = np.searchsorted(self.first, q, side="right") - 1
                left = self._same(w.hash, p, q, -1, size - k, begin[p], self.first[item])
                right = self._same(w.hash, p + k - 1, q + k - 1, 1, size - k, stop[p] - 1, self.first[item + 1] - 1)
                for i in np.flatnonzero(left + k + right >= size).tolist():
                    d, e, n = int(p[i] - left[i]), int(q[i] - left[i]), int(left[i] + k + right[i])
                    for b, c in self._spelled(raw, w, d, e, n, size):
                        yield b, c, int(item[i])

    def _same(self, h: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, most: int, end_p: np.ndarray, end_q: np.ndarray) -> np.ndarray:
        """How many words in a row after (or before) the places are the same."""
        out = np.zeros(len(p), dtype=np.int64)
        on = np.ones(len(p), dtype=bool)
        for j in range(1, most + 1):
            x, y = p + step * j, q + step * j
            on &= (x <= end_p) & (y <= end_q) if step > 0 else (x >= end_p) & (y >= end_q)
            on[on] = h[x[on]] == self.hash[y[on]]
            if not on.any():
                break
            out += on
        return out

    def _spelled(self, raw: bytes, w: Words, d: int, e: int, n: int, size: int) -> Iterator[tuple[int, int]]:
        """Spans of the ``n`` words from ``d`` that are spelled as the item's from ``e``; one, unless different words share a hash."""
        mine = [raw[a:b] for a, b in zip(w.start[d : d + n].tolist(), w.end[d : d + n].tolist(), strict=True)]
        theirs = self.raw[e : e + n]
        if mine == theirs:
            yield d, d + n
            return
        run = 0
        for i in range(n + 1):
            if i < n and mine[i] == theirs[i]:
                run += 1
                continue
            if run >= size:
                yield d + i - run, d + i
            run = 0


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """Items in blocks of about BLOCK words: how many, and each in turn; one block is in the driver's memory at a time."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), text.alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") / 6 + 1)).first()[0] or 0
    n = max(1, int(-(-total // BLOCK)))

    def each() -> Iterator[list[tuple[str, bytes]]]:
        for b in range(n):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t", "id"), F.lit(n)) == b)
            yield [(r["id"], r["t"].encode()) for r in part.collect()]

    return n, each()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words`` (long), ``spans`` (array of first word and end of the words hit, apart and in order) and ``items``
    (array of the ids, as sorted strings, of items with an occurring window).

    Null texts have no words and no hits; so have empty ones. An item of fewer than ``window`` words is one window, an item without
    words none. Repeated rows and rows with a null id each get their own result; items that repeat count once per id. Empty tables give no rows, or no hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    kind = "id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col)
    if n_blocks == 1:
        sent = spark.sparkContext.broadcast(pickle.dumps(Index(next(blocks), window)))
        return slim.mapInArrow(_kernel(sent), kind).withColumnRenamed("id", id_col)
    # Several blocks: one pass keeps the texts with any of their fingerprints (all texts, if these are too many to send), numbered in a table; each block then goes through those alone.
    sent = spark.sparkContext.broadcast(pickle.dumps(_prints(blocks, window)))
    counted = cut(slim.mapInArrow(_maybe(sent), "id long, n_words long, t string").withColumn("n", F.monotonically_increasing_id()), "numbered")
    maybe = counted.where("t is not null").select("n", "t")
    hits = []
    for block in _blocks(benchmark, item_col, item_text_col)[1]:
        sent = spark.sparkContext.broadcast(pickle.dumps(Index(block, window)))
        found = maybe.mapInArrow(_kernel(sent), kind).where("size(items) > 0")
        hits.append(cut(found.select(F.col("id").alias("n"), "spans", "items"), "hits"))
    hits = _union(hits)
    merged = hits.groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    joined = counted.select("n", "id", "n_words").join(merged, "n", "left")
    none = F.array().cast("array<struct<a:long,b:long>>")
    return joined.select(
        F.col("id").alias(id_col), "n_words", _joined_spans(F.coalesce("spans", none)).alias("spans"),
        F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"),
    )


def _prints(blocks: Iterator[list[tuple[str, bytes]]], window: int) -> dict[int, np.ndarray] | None:
    """Fingerprints of all blocks by window size; None where they are more than PRINTS."""
    found: dict[int, list[np.ndarray]] = {}
    total = 0
    for block in blocks:
        for size, x in Index(block, window).sizes.items():
            found.setdefault(size, []).append(x["prints"])
            total += len(x["prints"])
        if total > PRINTS:
            return None
    return {size: np.unique(np.concatenate(x)) for size, x in found.items()}


def _maybe(sent):
    """Words of each text, and the text itself if it has one of the fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = pickle.loads(sent.value)
        for batch in batches:
            at = 0
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                w = words(LOWER[data], offs, ALNUM)
                some = np.full(len(ids), prints is None)
                for size, known in (prints or {}).items():
                    starts = np.flatnonzero(np.arange(len(w.hash)) + size <= w.last_of_doc())
                    if len(starts):
                        place, g = select(w.hash, size, starts)
                        there = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                        some[np.searchsorted(w.first, place[there], side="right") - 1] = True
                texts = batch.column(1).slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.count, pa.int64()), pc.if_else(pa.array(some), texts, pa.scalar(None, texts.type))], names=["id", "n_words", "t"])

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _joined_spans(spans):
    """Spans in order, those that overlap or touch made one."""
    def step(done, s):
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (s["a"] <= F.try_element_at(done, F.lit(-1))["b"]), merged).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a:long,b:long>>"), step)


def _kernel(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = pickle.loads(sent.value)
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                data = LOWER[data]
                w = words(data, offs, ALNUM)
                found: dict[int, tuple[list, set]] = {}
                owner = None
                for begin, end, item in index.hits(data, w):
                    if owner is None:
                        owner = np.repeat(np.arange(len(ids)), w.count)
                    d = int(owner[begin])
                    spans, names = found.setdefault(d, ([], set()))
                    spans.append((begin - int(w.first[d]), end - int(w.first[d])))
                    names.add(item)
                spans, names = [[]] * len(ids), [[]] * len(ids)
                for d, (s, n) in found.items():
                    spans[d] = [{"a": a, "b": b} for a, b in merge(s)]
                    names[d] = sorted({name for j in n for name in index.names[j] if name is not None})
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(w.count, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))],
                    names=["id", "n_words", "spans", "items"],
                )

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
