"""Language identification with interpolated Kneser-Ney character models.

One model per language over characters of lower-cased words with a boundary mark. All languages share one sorted array of n-gram
hashes per order; a row of the matrix beside it holds the n-gram's log-probability in every language, so
a character costs one look-up whatever the number of languages, and an n-gram that no language has seen falls to the next
lower order. A text gets the language of lowest cross-entropy per character; it is rejected where
even that is nearer to what the models give to held-out texts with shuffled letters than to what they give to the language's own.

Training uses a bounded sample of labelled rows (``SAMPLE`` texts a language, chosen by a hash of the id, and
``CHARS`` characters of them); scoring reads every character of every text.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytescan import mix, slices

#: Longest n-gram.
ORDER = 5
#: Bounds of the training sample: texts and bytes a language. Model size and the driver's memory follow from these.
SAMPLE = 1_500
CHARS = 1_500_000
#: A language's limit lies midway between the cross-entropy (nats a character) below which this share of its held-out texts lies, and the one above
#: which that share of the same texts lies once their letters are shuffled.
QUANTILE = 0.995
#: Least distance of the limit from the former.
MARGIN = 0.2
#: Texts with fewer scored characters aren't rejected for their cross-entropy.
LEAST = 40

_EDGE = np.uint32(0x20)
_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case where that is a single letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def decode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the offsets of documents in them."""
    head = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum(head)])
    return points, before[offs]


def stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in lower case with one edge mark before, between and after runs of them; document bounds; letters per document."""
    points, bounds = decode(data, offs)
    low = _letters()[points]
    n_letters = np.concatenate([[0], np.cumsum(low > 0)])
    n_letters = np.diff(n_letters[bounds])
    # A mark stands before each document; runs of non-letters shrink to one mark.
    low = np.insert(low, bounds[:-1], 0)
    bounds = bounds + np.arange(len(bounds))
    low = np.append(low, np.uint32(0))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0)
    keep[bounds[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    s = low[keep]
    s[s == 0] = _EDGE
    return s, kept[bounds], n_letters


def hashes(s: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n from 1 to ``order`` the hash of the n characters that end at each position (the first n - 1 wrap and are not used)."""
    out, acc = [], np.zeros(len(s), dtype=np.uint64)
    x = s.astype(np.uint64) + np.uint64(1)
    for n in range(order):
        acc = acc + (np.roll(x, n) if n else x) * np.uint64(pow(_STEP, n + 1, 1 << 64))
        out.append(mix(acc + np.uint64(n)))
    return out


@dataclass
class Model:
    """Sorted hash arrays by order, and log-probabilities: a row per n-gram, a column per language."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    unknown: np.ndarray
    limit: np.ndarray
    scale: float

    def lookup(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash in the array of order n, and whether it is there. The top bits say where to start."""
        keys = self.keys[n]
        jump, bits = self._jump(n)
        lo = jump[(h >> np.uint64(64 - bits)).astype(np.int64)]
        hi = jump[(h >> np.uint64(64 - bits)).astype(np.int64) + 1]
        for _ in range(int(np.max(hi - lo, initial=0))):  # buckets of the jump table hold one key or so
            behind = (lo < hi) & (keys[np.minimum(lo, len(keys) - 1)] < h)
            if not behind.any():
                break
            lo = lo + behind
        lo = np.minimum(lo, len(keys) - 1)
        return lo, keys[lo] == h

    def _jump(self, n: int) -> tuple[np.ndarray, int]:
        cache = self.__dict__.setdefault("_jumps", {})
        if n not in cache:
            bits = max(8, int(len(self.keys[n])).bit_length() + 1)
            edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            jump = np.append(np.searchsorted(self.keys[n], edges), len(self.keys[n])).astype(np.int32)
            cache[n] = (jump, bits)
        return cache[n]

    def entropy(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character (documents x languages), characters scored, letters."""
        s, bounds, letters = stream(data, offs)
        order = len(self.keys)
        h = hashes(s, order)
        scored = np.ones(len(s), dtype=bool)
        scored[bounds[:-1][bounds[:-1] < len(s)]] = False  # the mark before a document
        scored[bounds[-1] :] = False
        depth = np.arange(len(s)) - np.repeat(bounds, np.append(np.diff(bounds), len(s) - bounds[-1]))
        total = np.zeros((len(s) + 1, len(self.langs)), dtype=np.float64)
        rows = np.zeros((len(s), len(self.langs)), dtype=np.float32)
        todo = np.flatnonzero(scored)
        for n in range(order - 1, -1, -1):
            can = todo[depth[todo] >= n]
            at, found = self.lookup(n, h[n][can])
            rows[can[found]] = self.logp[n][at[found]]
            if n:
                left = np.ones(len(s), dtype=bool)
                left[can[found]] = False
                todo = todo[left[todo]]
            else:
                rows[can[~found]] = self.unknown
        np.cumsum(rows, axis=0, out=total[1:])
        count = np.diff(np.concatenate([[0], np.cumsum(scored)])[bounds])
        return -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(count, 1)[:, None], count, letters


def _counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: sorted hashes, counts, and the hash of each one's context and of its tail (all but the first character)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, bounds, _ = stream(data, offs)
    h = hashes(s, ORDER)
    depth = np.arange(len(s)) - np.repeat(bounds, np.append(np.diff(bounds), len(s) - bounds[-1]))
    out = []
    for n in range(ORDER):
        ok = np.flatnonzero((depth >= max(n, 1)) & (np.arange(len(s)) < bounds[-1]))
        u, first, c = np.unique(h[n][ok], return_index=True, return_counts=True)
        pos = ok[first]
        context = h[n - 1][pos - 1] if n else np.zeros(len(u), dtype=np.uint64)
        tail = h[n - 1][pos] if n else np.zeros(len(u), dtype=np.uint64)
        out.append((u, c, context, tail))
    return out


def kneser_ney(counts, alphabet: int) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    """Interpolated probabilities by order: sorted hashes, probabilities, and back-off weight by context."""
    out = []
    lower = None
    for n in range(ORDER):
        u, c, context, tail = counts[n]
        if n < ORDER - 1:  # continuation counts: distinct characters before the n-gram
            above = counts[n + 1][3]
            a, k = np.unique(above, return_counts=True)
            at = np.minimum(np.searchsorted(a, u), max(len(a) - 1, 0))
            c = np.where(a[at] == u, k[at], 0) if len(a) else c
            c = np.maximum(c, 1)
        ones, twos = np.sum(c == 1), np.sum(c == 2)
        d = ones / (ones + 2 * twos) if ones + twos else 0.5
        d = min(max(d, 0.1), 0.95)
        ctx, inv = np.unique(context, return_inverse=True)
        total = np.bincount(inv, weights=c, minlength=len(ctx))
        kinds = np.bincount(inv, minlength=len(ctx))
        gamma = d * kinds / np.maximum(total, 1)
        if n == 0:
            below = np.full(len(u), 1.0 / alphabet)
        else:
            lu, lp = lower
            at = np.minimum(np.searchsorted(lu, tail), len(lu) - 1)
            below = np.where(lu[at] == tail, lp[at], 1.0 / alphabet)
        p = np.maximum(c - d, 0) / total[inv] + gamma[inv] * below
        out.append((u, p, (ctx, gamma)))
        lower = (u, p)
    return out


def train(texts: dict[str, list[bytes]], held: dict[str, list[bytes]]) -> Model:
    """Model of the languages' texts; ``held`` texts, disjoint from them, set the rejection limits and the scale of the score."""
    langs = sorted(texts)
    counts = {lang: _counts(texts[lang]) for lang in langs}
    alphabet = 1 + max(16, len(np.unique(np.concatenate([counts[lang][0][0] for lang in langs])))) * 2
    models = {lang: kneser_ney(counts[lang], alphabet) for lang in langs}
    keys, logp = [], []
    for n in range(ORDER):
        every, at = np.unique(np.concatenate([models[lang][n][0] for lang in langs]), return_index=True)
        # Context and tail of every n-gram, whichever language it came from, to back off where a language hasn't seen it.
        context = np.concatenate([counts[lang][n][2] for lang in langs])[at]
        tail = np.concatenate([counts[lang][n][3] for lang in langs])[at]
        table = np.empty((len(every), len(langs)))
        for j, lang in enumerate(langs):
            u, p, (ctx, gamma) = models[lang][n]
            i = np.minimum(np.searchsorted(u, every), len(u) - 1)
            known = u[i] == every
            if n:
                low = np.minimum(np.searchsorted(keys[n - 1], tail), len(keys[n - 1]) - 1)
                below = np.where(keys[n - 1][low] == tail, logp[n - 1][low, j], 1.0 / alphabet)
            else:
                below = np.full(len(every), 1.0 / alphabet)
            g = np.minimum(np.searchsorted(ctx, context), len(ctx) - 1)
            weight = np.where(ctx[g] == context, gamma[g], 1.0)
            table[:, j] = np.where(known, p[i], weight * below)
        keys.append(every)
        logp.append(table)
    model = Model(langs, keys, [np.log(np.maximum(t, 1e-12)).astype(np.float32) for t in logp], np.full(len(langs), -np.log(alphabet), dtype=np.float32), np.full(len(langs), np.inf), 1.0)
    limits, gaps = [], []
    for j, lang in enumerate(langs):
        rows = [t for t in held.get(lang, []) if t]
        if not rows:
            limits.append(np.inf)
            continue
        ce, count, _ = model.entropy(np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in rows])]))
        own = ce[count >= LEAST, j]
        if len(own):
            noise = [_shuffled(t) for t, c in zip(rows, count, strict=True) if c >= LEAST]
            far = model.entropy(np.frombuffer(b"".join(noise), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in noise])]))[0].min(axis=1)
            near = float(np.quantile(own, QUANTILE))
            limits.append(near + max(MARGIN, 0.5 * (float(np.quantile(far, 1 - QUANTILE)) - near)))
        else:
            limits.append(np.inf)
        others = np.delete(ce, j, axis=1)
        gaps += (others.min(axis=1) - ce[:, j]).tolist() if others.shape[1] else []
    good = np.median([g for g in gaps if g > 0]) if any(g > 0 for g in gaps) else 0.1
    model.limit = np.array(limits)
    model.scale = 6.0 / max(float(good), 1e-3)  # a usual lead gives a score near 1
    return model


def _shuffled(text: bytes) -> bytes:
    """The text with its letters in another order, and everything else in place."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), dtype=np.uint32).copy()
    at = np.flatnonzero(_letters()[points] > 0)
    points[at] = points[np.random.default_rng(len(at)).permutation(at)]
    return points.tobytes().decode("utf-32-le").encode()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from the labelled rows of ``docs``, or None if there are none. Rows without text or language teach nothing."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    rows = rows.where("t is not null and lang is not null and length(t) > 0")
    # A sample by hash of the id: the rate comes from counts, so ranking sees a small multiple of the sample only.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * SAMPLE / n + 20.0 / n))])
    order = F.xxhash64("id", F.lit(17))
    drawn = rows.withColumn("o", order).where(F.pmod("o", F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "id"))).where(F.col("r") <= SAMPLE)
    drawn = drawn.withColumn("sofar", F.sum(F.octet_length("t")).over(Window.partitionBy("lang").orderBy("r"))).where((F.col("sofar") <= CHARS) | (F.col("r") == 1))
    texts: dict[str, list[bytes]] = {}
    held: dict[str, list[bytes]] = {}
    for r in drawn.select("lang", "r", "t").toLocalIterator():
        (held if r["r"] % 6 == 0 else texts).setdefault(r["lang"], []).append(r["t"].encode())
    return train(texts, held)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (0 to 1), ``entropy`` (nats a character, null without letters) and ``rejected``.

    A text that is null, empty or without a letter is ``und`` with score 0 and rejected; so is every text if there is no model. Ties go to the
    language first in order of name. Repeated rows get equal results. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(model, protocol=5), 1))
    return slim.mapInArrow(_kernel(sent), "id long, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)


def verdict(spark, model: Model | None):
    """A column function of the text: whether the document is rejected."""
    sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(model, protocol=5), 1))
    judge = _kernel(sent)

    @F.arrow_udf("boolean")
    def rejected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["id", "t"])
            out = [b.column("rejected") for b in judge(iter([rows]))]
            yield pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return rejected


_LOADED: dict[int, Model] = {}


def _kernel(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = sent.value
        key = zlib.crc32(blob)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = pickle.loads(zlib.decompress(blob))
        model = _LOADED[key]
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1), 1 << 18):
                if model is None:
                    ce, count, letters = np.zeros((len(ids), 1)), np.zeros(len(ids)), np.zeros(len(ids))
                    langs, limit, scale = ["und"], np.array([np.inf]), 1.0
                else:
                    ce, count, letters = model.entropy(data, offs)
                    langs, limit, scale = model.langs, model.limit, model.scale
                best = np.argmin(ce, axis=1)
                low = ce[np.arange(len(ids)), best]
                some = letters > 0
                # Longer texts are surer: the lead per character counts with the square root of their length.
                lead = (ce - low[:, None]) * scale * np.sqrt(np.clip(count, 1, 400) / 100.0)[:, None]
                score = np.where(some, 1 / np.exp(-lead).sum(axis=1), 0.0)
                rejected = ~some | ((low > limit[best]) & (count >= LEAST))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.where(some, np.array(langs, dtype=object)[best], "und").tolist(), pa.string()),
                    pa.array(score), pa.array(np.where(some, low, np.nan), from_pandas=True), pa.array(rejected),
                ], names=["id", "lang_pred", "score", "entropy", "rejected"])

    return run
