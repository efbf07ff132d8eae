"""Scoring texts with a log-bilinear language model.

Token counts come from all training texts: tasks add up their own words, one shuffle adds the tasks up, and the table stays in the
shared folder. The words seen ``LEAST`` times or more (``FEW`` at least, ``WORDS`` at most) and one class for all others are the model's vocabulary, in order of
frequency, cut into groups that grow with the rank of their words. The vector of a context is a linear map of the vectors of the words before (mean of a window, and the last one).
Its product with a group's vector, plus the log of the group's frequency, is the group's energy; its product with a word's vector, plus the log of the word's frequency in its
group, is the word's.

Vectors are trained in numpy by noise-contrastive estimation, of groups against groups and of words against words of the same group, on all training texts, each whole. They start from a pass over
about ``SAMPLE`` whole texts in one task; in each of ``ROUNDS`` every task goes through its texts from the same vectors, and a shuffle averages what the tasks changed, row by row, weighted by how often a task met the row.

A token's probability is that of its group times its own within the group. Both come from products of the matrix of the tokens' own context vectors with that of all groups, and with that of
all words of a group, and are normalised exactly. A word of the class of others adds its share of that class, (c + 0.5) / (sum of those). Counts of
the ``HEAD`` most frequent words (a fixed number) travel to the tasks; the rare words of all texts meet their counts in a join.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, SPACED, slices, words
from .shared import cut, forget

#: Count from which a word has a vector of its own, and so many words have one whatever their counts.
LEAST = 50
FEW = 4096
#: Most words whose counts are sent to the tasks, at 16 bytes each.
HEAD = 1 << 18
#: Most words with vectors, at 8 x WIDTH bytes each in a scoring task: a bound of memory.
WORDS = HEAD
#: Words before a token that its context holds.
SPAN = 16
#: Length of vectors.
WIDTH = 16
#: Texts, whole ones, from which vectors start. Training itself covers all texts.
SAMPLE = 2_500
#: Passes over all training texts.
ROUNDS = 1
#: Tokens of a step; noise groups that they share, and noise words that those of a group share.
BATCH = 1024
NOISE = 32
WITHIN = 4
#: Words of the smallest and of the largest groups.
SMALL, LARGE = 32, 1024
#: Tokens from which a task handles the texts that it has read; tokens whose contexts are made at once; cells of a product of matrices.
CHUNK = 1 << 18
ROWS = 1 << 12
CELLS = 1 << 17
#: Largest energy, apart from frequencies.
TOP = np.float32(60)
#: Parts in which tasks' changes are averaged.
PARTS = 64
#: Weight of the model against the frequencies alone.
TRUST = 0.92
#: Hash that stands for the end of a text.
END = np.uint64(0xE0D0_0F7E_87E4_7001)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, each text followed by its end, and the texts' bounds in them."""
    w = words(LOWER[data], offs, SPACED)
    bounds = w.first + np.arange(len(w.first))
    out = np.insert(w.hash, w.first[1:], END)
    return out, bounds


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by token of all of a task's texts, in parts of bounded size."""
    parts, size = [], 0

    def out(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    for batch in batches:
        for _, data, offs in slices(batch.column(0), batch.column(1)):
            u, c = np.unique(tokens(data, offs)[0], return_counts=True)
            parts.append((u, c.astype(np.int64)))
            size += len(u)
            if size > 2_000_000:
                parts = [_tally(parts)]
                size = len(parts[0][0])
                if size > 1_500_000:
                    yield out(*parts[0])
                    parts, size = [], 0
    if parts:
        yield out(*_tally(parts))


class Places:
    """Places of hashes in a sorted array; their first bits say where to begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(8, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.jump = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        at = self.jump[(h >> self.shift).astype(np.int64)]
        found = self.keys[at]
        todo = np.flatnonzero(found < h)
        while len(todo):
            at[todo] += 1
            k = self.keys[at[todo]]
            found[todo] = k
            todo = todo[k < h[todo]]
        return at, (found == h) & (at < len(self.keys) - 1)


@dataclass
class Layout:
    """The vocabulary: its words' hashes in order, their places by frequency, and frequencies by place; the last place is the class of others."""

    vocab: np.ndarray
    place: np.ndarray
    unigram: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.vocab)
        # Groups grow with the rank of their words: tokens are mostly frequent words, and those of small groups cost little.
        first = [0]
        while first[-1] < k:
            first.append(min(k, first[-1] + min(max(SMALL, first[-1] // 16), LARGE)))
        self.first = np.array(first)
        self.groups = len(first) - 1  # the class of others is one more
        self.group = np.append(np.repeat(np.arange(self.groups), np.diff(self.first)), self.groups).astype(np.int32)
        self.shares = np.add.reduceat(self.unigram, self.first)
        self.deal = np.cumsum(self.unigram)
        self.shares_deal = np.cumsum(self.shares)
        self.within = (self.unigram / self.shares[self.group]).astype(np.float32)
        self.places = Places(self.vocab)
        self.by_place = np.append(self.place, k).astype(np.int32)

    def classes(self, h: np.ndarray) -> np.ndarray:
        k = len(self.vocab)
        if not k:
            return np.zeros(len(h), dtype=np.int32)
        at, there = self.places.find(h)
        return np.where(there, self.by_place[at], np.int32(k))


@dataclass
class State:
    """Vectors: of words in the context, of words and groups to predict, scales of the window's mean and the last word; mean squared gradients' sums by row, for Adagrad."""

    r: np.ndarray
    q: np.ndarray
    s: np.ndarray
    gain: np.ndarray
    gr: np.ndarray
    gq: np.ndarray
    gs: np.ndarray
    gg: np.ndarray

    def copy(self) -> State:
        return State(*(x.copy() for x in vars(self).values()))


@dataclass
class Model:
    """What the tasks need: counts of frequent words, the vocabulary and its vectors."""

    n: int
    v: int
    head: np.ndarray  # sorted hashes
    count: np.ndarray
    layout: Layout
    state: State
    others: float  # log10 of the sum of c + 0.5 over the words without a vector, one unknown word included
    least: int  # step of the smallest count in the head

    def __post_init__(self) -> None:
        self.places = Places(self.head)
        self.head_class = np.append(self.layout.classes(self.head), len(self.layout.vocab)).astype(np.int32)
        self.head_count = np.append(self.count, -1)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count of frequent words, -1 for others, and all words' classes: the vocabulary is among the frequent words."""
        at, there = self.places.find(h)
        at = np.where(there, at, len(self.head))
        return self.head_count[at], self.head_class[at]

    def _bounded(self, x: np.ndarray) -> np.ndarray:
        """Contexts, shortened where an energy could pass TOP."""
        norm = lambda v: np.sqrt(np.einsum("nd,nd->n", v, v))
        most = max(float(norm(self.state.q).max(initial=0)), float(norm(self.state.s).max(initial=0)), 1e-9)
        return x * np.minimum(1, TOP / np.maximum(norm(x) * np.float32(most), TOP))[:, None]

    def _groups(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponents of the groups' energies, frequencies apart, and what to divide by."""
        e = x @ self.state.s.T
        np.exp(e, out=e)
        return e, e @ self.layout.shares.astype(np.float32)

    def _words(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the words of a group."""
        some = slice(self.layout.first[g], self.layout.first[g + 1])
        e = x @ self.state.q[some].T
        np.exp(e, out=e)
        return e, e @ self.layout.within[some]

    def log10(self, cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's class after its context."""
        lay = self.layout
        x = self._bounded(contexts(self.state, cls, bounds))
        g = lay.group[cls]
        p = np.empty(len(cls), dtype=np.float32)
        # Products of a size that stays in the processor's cache.
        rows = max(64, CELLS // (lay.groups + 1))
        for a in range(0, len(cls), rows):
            part = g[a : a + rows]
            e, z = self._groups(x[a : a + rows])
            p[a : a + rows] = e[np.arange(len(part)), part] / z
        order = np.argsort(g.astype(np.uint16), kind="stable")
        ends = np.searchsorted(g[order], np.arange(lay.groups + 1))
        for j in np.flatnonzero(np.diff(ends)).tolist():
            rows = max(64, CELLS // int(lay.first[j + 1] - lay.first[j]))
            for a in range(ends[j], ends[j + 1], rows):
                at = order[a : min(a + rows, ends[j + 1])]
                e, z = self._words(x[at], j)
                p[at] *= e[np.arange(len(at)), cls[at] - lay.first[j]] / z
        u = lay.unigram[cls]
        return np.log10(u * (TRUST * p + (1 - TRUST)))

    def every(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the whole vocabulary after contexts; for small vocabularies."""
        x = self._bounded(x)
        e, z = self._groups(x)
        p = (e / z[:, None])[:, self.layout.group]
        for j in range(self.layout.groups):
            e, z = self._words(x, j)
            p[:, self.layout.first[j] : self.layout.first[j + 1]] *= e / z[:, None]
        return self.layout.unigram * (TRUST * p + (1 - TRUST))


def _before(r: np.ndarray, cls: np.ndarray, begin: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens from a to b: the mean of up to SPAN words before each in its text, and the last one."""
    lo = max(0, a - SPAN)
    rows = r[cls[lo:b]]
    total = np.zeros((len(rows) + 1, WIDTH), np.float32)
    np.cumsum(rows, axis=0, out=total[1:])
    i = np.arange(a - lo, b - lo)
    first = np.maximum(begin[a:b] - lo, i - SPAN)
    mean = (total[i] - total[np.maximum(first, 0)]) / np.float32(SPAN)
    last = rows[i - 1]
    last[i == begin[a:b] - lo] = 0
    return mean, last


def contexts(s: State, cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Context vector of each token."""
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    out = np.empty((len(cls), WIDTH), np.float32)
    for a in range(0, len(cls), ROWS):
        b = min(a + ROWS, len(cls))
        mean, last = _before(s.r, cls, begin, a, b)
        out[a:b] = mean * s.gain[0] + last * s.gain[1]
    return out


def start(k: int, groups: int, seed: int = 7) -> State:
    rng = np.random.default_rng(seed)
    r, q, s = (rng.normal(0, d, (n, WIDTH)).astype(np.float32) for d, n in ((0.3, k), (0.05, k), (0.05, groups)))
    return State(r, q, s, np.ones((2, WIDTH), np.float32), *(np.full(n, 1e-6, np.float32) for n in (k, k, groups, (2, WIDTH))))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _change(target: np.ndarray, acc: np.ndarray, index: np.ndarray, g: np.ndarray, rate: float) -> None:
    """A step of Adagrad on the rows ``index``; rows that come several times get the sum."""
    order = np.argsort(index)
    index = index[order]
    first = _firsts(index)
    rows, g = index[first], np.add.reduceat(g[order], first, axis=0)
    seen = acc[rows] + np.einsum("nd,nd->n", g, g) / np.float32(WIDTH)
    acc[rows] = seen
    g *= (rate / np.sqrt(seen)).astype(np.float32)[:, None]
    target[rows] -= g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def learn(s: State, cls: np.ndarray, bounds: np.ndarray, layout: Layout, rng: np.random.Generator, rate: float = 0.15) -> None:
    """One pass over texts (classes, bounds), changing ``s``."""
    with np.errstate(over="ignore"):
        _learn(s, cls, bounds, layout, rng, rate)


def _learn(s: State, cls: np.ndarray, bounds: np.ndarray, layout: Layout, rng: np.random.Generator, rate: float) -> None:
    begin, end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    groups, top = layout.groups, layout.first
    low = np.append(0, layout.deal)[top[:-1]]
    width = layout.deal[top[1:] - 1] - low if groups else low
    log_noise, log_within = np.float32(np.log(NOISE)), np.float32(np.log(WITHIN))
    for a in range(0, len(cls), BATCH):
        lo, b = max(0, a - SPAN), min(a + BATCH, len(cls))
        mean, last = _before(s.r, cls, begin, a, b)
        h = mean * s.gain[0] + last * s.gain[1]
        w, g = cls[a:b], layout.group[cls[a:b]]
        # Groups against noise groups that the step shares.
        noise = np.minimum(np.searchsorted(layout.shares_deal, rng.random(NOISE) * layout.shares_deal[-1]), groups)
        sg, sn = s.s[g], s.s[noise]
        own = _sigmoid(np.einsum("nd,nd->n", h, sg) - log_noise) - 1
        other = _sigmoid(h @ sn.T - log_noise)
        dh = own[:, None] * sg + other @ sn
        changes = [(s.s, s.gs, np.concatenate([g, noise]), np.concatenate([own[:, None] * h, other.T @ h]))]
        # Words against noise words of their group.
        order = np.argsort(g.astype(np.uint16), kind="stable")  # few groups: sorted by digits
        order = order[: len(order) - int(np.count_nonzero(g == groups))]
        if len(order):
            ws, hs, gs = w[order], h[order], g[order]
            first = _firsts(gs)
            there = gs[first]
            drawn = low[there, None] + np.sort(rng.random((len(there), WITHIN)), axis=1) * width[there, None]
            noise = np.clip(np.searchsorted(layout.deal, drawn), top[there, None], top[there + 1, None] - 1)
            qw, qn = s.q[ws], s.q[noise][np.repeat(np.arange(len(there)), np.diff(np.append(first, len(gs))))]
            own = _sigmoid(np.einsum("nd,nd->n", hs, qw) - log_within) - 1
            other = _sigmoid(np.einsum("njd,nd->nj", qn, hs) - log_within)
            dh[order] += own[:, None] * qw + np.einsum("nj,njd->nd", other, qn)
            pulled = np.add.reduceat(other[:, :, None] * hs[:, None, :], first, axis=0).reshape(-1, WIDTH)
            changes.append((s.q, s.gq, np.concatenate([ws, noise.ravel().astype(np.int32)]), np.concatenate([own[:, None] * hs, pulled])))
        # A word gets what the contexts of the SPAN words after it in its text get.
        i = np.arange(b - lo)
        after = np.minimum(end[lo:b] - lo, b - lo)
        run = np.zeros((b - lo + 1, WIDTH), np.float32)
        np.cumsum(dh, axis=0, out=run[a - lo + 1 :])
        dr = (run[np.minimum(i + SPAN + 1, after)] - run[i + 1]) * (s.gain[0] / SPAN)
        follows = np.flatnonzero((i + 1 < after) & (i + 1 >= a - lo))
        dr[follows] += dh[follows + 1 - (a - lo)] * s.gain[1]
        changes.append((s.r, s.gr, cls[lo:b], dr))
        for target, acc, index, x in changes:
            _change(target, acc, index, x, rate)
        d = np.stack([np.einsum("nd,nd->d", dh, mean), np.einsum("nd,nd->d", dh, last)])
        s.gg += d**2
        s.gain -= 0.02 * d / np.sqrt(s.gg)


def _joined(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of all texts of a column, and the texts' bounds in them, some whole texts at a time."""
    texts: list[np.ndarray] = []
    size = 0
    for i, x in enumerate(column):
        texts.append(np.frombuffer(x.as_buffer(), dtype=np.int32))
        size += len(texts[-1])
        if size > CHUNK or i == len(column) - 1:
            yield np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            texts, size = [], 0


def _begun(sample: DataFrame, s: State, layout: Layout) -> State:
    """``s`` after a pass over a sample of bounded size, in one task."""
    sent = sample.sparkSession.sparkContext.broadcast(pickle.dumps((s, layout)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words_ = pickle.loads(sent.value)
        rng = np.random.default_rng(7)
        for batch in batches:
            for cls, bounds in _joined(batch.column(0)):
                learn(now, cls, bounds, words_, rng)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(now)], pa.binary())], names=["x"])

    # In an order of its own: the shuffle's would change from run to run.
    row = sample.repartition(1).sortWithinPartitions(F.xxhash64("c"), "c").mapInArrow(run, "x binary").first()
    sent.unpersist()
    return pickle.loads(row["x"]) if row else s


def _pass(table: DataFrame, s: State, layout: Layout, seed: int) -> State:
    """A pass over all texts: tasks train on their own from ``s``, and rows are averaged over the tasks that met them."""
    sent = table.sparkSession.sparkContext.broadcast(pickle.dumps((s, layout)))
    k = len(s.r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        old, words_ = pickle.loads(sent.value)
        now, met, n = old.copy(), np.zeros(k, np.float32), 0
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for batch in batches:
            for cls, bounds in _joined(batch.column(0)):
                learn(now, cls, bounds, words_, rng)
                met += np.bincount(cls, minlength=k)
                n += len(cls)
        if not n:
            return
        for part in range(PARTS):
            blobs = []
            for new, was, acc, acc_was in ((now.q, old.q, now.gq, old.gq), (now.r, old.r, now.gr, old.gr)):
                rows = np.flatnonzero(acc[part::PARTS] != acc_was[part::PARTS]).astype(np.int32)
                at = rows * PARTS + part
                blobs.append((rows, np.maximum(met[at], 1), (new[at] - was[at]).astype(np.float16), acc[at] - acc_was[at]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(pickle.dumps(blobs), 1)], pa.binary())], names=["part", "x"])
        small = [float(n)] + [n * (getattr(now, x) - getattr(old, x)).astype(float) for x in _SMALL]
        yield pa.RecordBatch.from_arrays([pa.array([PARTS], pa.int32()), pa.array([pickle.dumps(small)], pa.binary())], names=["part", "x"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part == PARTS:
                    v = pickle.loads(x.as_buffer())
                    sums[part] = [p + q for p, q in zip(sums[part], v, strict=True)] if part in sums else v
                    continue
                size = len(range(part, k, PARTS))
                held = sums.setdefault(part, [(np.zeros(size), np.zeros((size, WIDTH)), np.zeros(size)) for _ in range(2)])
                for (w, d, g), (rows, m, delta, acc) in zip(held, pickle.loads(zlib.decompress(x.as_buffer())), strict=True):
                    w[rows] += m
                    d[rows] += m[:, None] * delta.astype(float)
                    g[rows] += m * acc
        for part, v in sums.items():
            out = [x / v[0] for x in v[1:]] if part == PARTS else [((d / np.maximum(w, 1)[:, None]).astype(np.float32), (g / np.maximum(w, 1)).astype(np.float32)) for w, d, g in v]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], names=["part", "x"])

    schema = "part int, x binary"
    after = s.copy()
    for row in table.mapInArrow(run, schema).repartition(PARTS, "part").mapInArrow(mean, schema).toLocalIterator():
        v = pickle.loads(row["x"])
        if row["part"] == PARTS:
            for name, x in zip(_SMALL, v, strict=True):
                getattr(after, name)[...] += x.astype(np.float32)
        else:
            for (d, g), target, acc in zip(v, (after.q, after.r), (after.gq, after.gr), strict=True):
                target[row["part"] :: PARTS] += d
                acc[row["part"] :: PARTS] += g
    sent.unpersist()
    return after


#: Parts of the state that every task changes as a whole.
_SMALL = ("s", "gain", "gs", "gg")


def _step():
    """Counts in steps of an eighth of a power of two."""
    return F.floor(8 * F.log2("c")).cast("int")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of ``docs`` and the table of all token counts (``h`` hash, ``c`` count)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    counts = cut(slim.mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    v, n = total["v"], total["n"] or 0
    # The count at which HEAD words at most are left: from a histogram of a few hundred rows.
    bars = sorted(((r["s"], r["k"]) for r in counts.groupBy(_step().alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    kept, least = 0, 1 << 30
    for s, k in bars:
        if kept + k > HEAD:
            break
        kept, least = kept + k, s
    rows = counts.where(_step() >= least).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    c = rows.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    # The vocabulary by frequency, ties by hash.
    top = np.argsort(-c, kind="stable")[: min(WORDS, max(FEW, int((c >= LEAST).sum())))]
    rest = n - int(c[top].sum()) + 0.5 * (v - len(top) + 1)
    weight = np.append(c[top] + 0.5, rest)
    by_hash = np.argsort(h[top])
    layout = Layout(h[top][by_hash], by_hash.astype(np.int32), weight / weight.sum())
    state = start(len(weight), layout.groups + 1)
    if n:
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(layout))
        size = slim.count()
        table = cut(slim.mapInArrow(_classes(sent), "c binary, draw double"), "classes")
        state = _begun(table.where(F.col("draw") < SAMPLE / size).select("c"), state, layout)
        for i in range(ROUNDS):
            state = _pass(table.select("c"), state, layout, i)
        forget(table)
    return Model(n, v, h, c, layout, state, float(np.log10(rest)), least), counts


def _classes(sent):
    """Classes of each whole text, and a number from 0 to 1 that draws texts for the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout: Layout = pickle.loads(sent.value)
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                h, bounds = tokens(data, offs)
                cls = layout.classes(h)
                out = [cls[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                draw = [(zlib.crc32(x) ^ zlib.crc32(str(i).encode())) / 2**32 for i, x in zip(ids.to_pylist(), out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(draw, pa.float64())], names=["c", "draw"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10, add-half frequencies) and ``score`` (log10 probability of
    the text and its end in the model).

    A null or empty text is its end alone. Repeated rows each get their own, equal result. An empty table gives no rows; without training tokens both scores are those of an empty model. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, n_tokens long, n_known long, base double, model double, n_rare long, rare array<long>, times array<int>"
    rows = cut(slim.mapInArrow(_score(sent), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.where("n_rare > 0").select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    met = rare.join(counts.where(_step() < model.least), "h", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen"),
    )
    z = float(np.log10(model.n + 0.5 * (model.v + 1)))
    both = rows.select("row", "id", "n_tokens", "n_known", "base", "model", "n_rare").join(met, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_rare") * z).alias("base_score"), (F.col("model") + logs - F.col("n_rare") * model.others).alias("score"),
    )


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(sent.value)
        z = np.log10(model.n + 0.5 * (model.v + 1))
        k = len(model.layout.vocab)
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                h, bounds = tokens(data, offs)
                count, cls = model.known(h)
                seen = count >= 0
                logs = np.where(seen, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                own = model.log10(cls, bounds).astype(float) + np.where((cls == k) & seen, logs - model.others, 0.0)
                add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])  # noqa: E731, B023
                n_rare = add(~seen)
                doc = np.repeat(np.arange(len(ids)), np.diff(bounds))[~seen]
                rare = h[~seen]
                # One entry per distinct rare word of a text.
                order = np.lexsort((rare, doc))
                rare, doc = rare[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])])) if len(rare) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                lists = np.searchsorted(doc[new], np.arange(len(ids) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.diff(bounds), pa.int64()), pa.array(add(seen & (count > 0)), pa.int64()), pa.array(add(np.where(seen, logs - z, 0.0))),
                    pa.array(add(own)), pa.array(n_rare, pa.int64()), pa.ListArray.from_arrays(lists, pa.array(rare[new].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times)),
                ], names=["id", "n_tokens", "n_known", "base", "model", "n_rare", "rare", "times"])

    return run
