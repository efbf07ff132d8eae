"""Toxicity by a weighted lexicon.

Texts are folded (look-alike letters of other scripts, full-width forms, invisible characters, digits and signs that
stand for letters inside a word), then one Aho-Corasick automaton finds every lexicon term at the start of
a word. A hit inside an exception phrase doesn't count. The weights of what is left, and their share of the text's length, go
through a logistic curve.

Terms, weights, exceptions and curve are learned from labelled rows: a term is a word or a word beginning that
toxic documents use far more often than the others. Learning uses about ``TOXIC`` toxic and ``CLEAN`` other labelled documents, drawn by a hash of the id,
and keeps the ``TERMS`` strongest terms.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Bounds of the training sample, in documents.
TOXIC = 3_000
CLEAN = 6_000
#: Most terms in a learned lexicon.
TERMS = 2_000
#: Lengths of word beginnings that may become terms; longer words are candidates as a whole.
STEMS = (4, 5, 6, 7, 8)

# Letters that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгеёзиїійклмнорстухѕјһԁԛԝαβγδεηικμνορστυχωıɑɡ",
    "a6bree3uiiiklmhopctyxsjhdqwabydenikuvopstuxwiag",
)
# Digits and signs that stand for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_UNUSUAL = re.compile("[^\x00-\xac\xae-\u02af\u2010-\u2027\u2030-\u205e]")
_SIGN = re.compile(r"(?<=[^\W\d_])[\d@$!|+]+(?=[^\W\d_])|\b\d+(?=[^\W\d_])|(?<=[^\W\d_])\d+\b")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower-cased text in which disguised letters are plain ones."""
    text = text.lower()
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFKC", text).lower()
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn")).translate(_LOOKALIKES)
    elif "\xad" in text:
        text = text.replace("\xad", "")
    return _SIGN.sub(lambda m: "".join(_SIGNS.get(c, c) for c in m[0]), text)


@dataclass
class Lexicon:
    """Weights by term (``*`` at its end: a word beginning), exception phrases, and the curve's parameters."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            stem, whole = term.rstrip("*"), not term.endswith("*")
            for form in {stem, stem.replace("l", "i")}:  # 1 stands for l as well as for i
                if form not in a or (a.get(form)[2] and not whole):  # `word*` covers `word`
                    a.add_word(form, (len(form), weight, whole, term))
        e = ahocorasick.Automaton()
        for phrase in self.exceptions:
            e.add_word(phrase, len(phrase))
        for x in (a, e):
            if len(x):
                x.make_automaton()
        return a if len(a) else None, e if len(e) else None


def matches(text: str, automaton, exceptions) -> list[tuple[int, int, float, str]]:
    """Start, end, weight and term of the hits in a folded text; of hits with the same start the longest counts."""
    if automaton is None:
        return []
    found: dict[int, tuple[int, int, float, str]] = {}
    for last, (size, weight, whole, term) in automaton.iter(text):
        a, b = last + 1 - size, last + 1
        if (a and text[a - 1].isalpha()) or (whole and b < len(text) and text[b].isalpha()):
            continue
        if a not in found or found[a][1] < b:
            found[a] = (a, b, weight, term)
    if found and exceptions is not None:
        # One sweep: of the phrases that begin no later than a hit, the one that reaches farthest decides.
        phrases = sorted((last + 1 - size, last + 1) for last, size in exceptions.iter(text))
        at, reach = 0, 0
        for a in sorted(found):
            while at < len(phrases) and phrases[at][0] <= a:
                reach = max(reach, phrases[at][1])
                at += 1
            if found[a][1] <= reach:
                del found[a]
    return [found[a] for a in sorted(found)]


def features(hits: list, n_chars: int) -> tuple[float, float]:
    """Weight found, and weight per 1000 characters, both on a logarithmic scale."""
    total = sum(h[2] for h in hits)
    return math.log1p(max(total, 0.0)), math.log1p(1000.0 * max(total, 0.0) / (n_chars + 200.0))


def _squash(curve: tuple[float, ...], x: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: list[str] | None = None) -> Lexicon:
    """Lexicon from the labelled rows. Rows without a label, and labels without a row, teach nothing; no labelled rows give an empty lexicon."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return Lexicon({}, exceptions or [])
    part = lambda y, most: (F.col("y") == y) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < min(1.0, most / max(n.get(y, 0), 1)) * (1 << 20))
    # The hash alone draws the sample; where it draws far too many, those of smallest hash stay.
    drawn = marked.where(part(1, TOXIC) | part(0, CLEAN)).orderBy(F.xxhash64("id", F.lit(5)), "id", "y").limit(2 * (TOXIC + CLEAN))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sample = cut(slim.join(F.broadcast(drawn), "id").select("y", "t"), "labelled")

    counts = sample.mapInArrow(_count_candidates, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions or [])
    # A term must be likelier than chance by more than the number of candidates tried explains (log-likelihood ratio).
    both = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") * (n1 + n0) / (both * n1)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") * (n1 + n0) / (both * n0))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    counts = cut(counts.where("toxic > 0").withColumn("gain", gain).withColumn("odds", odds), "candidates")
    tried = counts.count()
    best = counts.where(F.col("gain") > math.log(max(tried, 1)) + 3).where("odds > 1.5").orderBy(F.desc("gain"), "term").limit(4 * TERMS)
    lexicon = Lexicon(_choose([(r["term"], r["toxic"], r["clean"], r["odds"]) for r in best.collect()]), exceptions or [])
    sent = pickle.dumps(lexicon)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent)
        a, e = own.automaton()
        for batch in batches:
            rows = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = fold(t or "")
                hits = matches(text, a, e)
                rows.append((y, *features(hits, len(text)), sorted({p for h in hits for p in _phrases(text, h)}) if y == 0 else []))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string())), strict=True)], names=["y", "a", "b", "phrases"])

    evident = cut(sample.mapInArrow(evidence, "y int, a double, b double, phrases array<string>"), "evidence")
    # A phrase around a hit that clean documents use again and again is an exception.
    often = evident.select(F.explode("phrases").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(5, n0 // 400))
    lexicon.exceptions = sorted({*lexicon.exceptions, *(r["p"] for r in often.collect())})
    seen = evident.select("y", "a", "b").collect()  # three numbers a sampled document
    lexicon.curve = _curve(np.array([[1.0, r["a"], r["b"]] for r in seen]), np.array([r["y"] for r in seen], dtype=float))
    return lexicon


def _count_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by candidate term, in one Counter a task that is passed on when it is large."""
    tallies = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = sorted({*tallies[0], *tallies[1]})
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([tallies[1][t] for t in terms], pa.int64()), pa.array([tallies[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
        for t in tallies:
            t.clear()
        return out

    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            distinct = set(_WORD.findall(fold(t or "")))
            stems = {w[:k] + "*" for w in distinct for k in STEMS if len(w) >= k}
            tallies[int(y == 1)].update(distinct | stems)
            if len(tallies[0]) + len(tallies[1]) > 300_000:
                yield flush()
    yield flush()


def _choose(candidates: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Terms by strength, leaving out those whose documents another chosen one covers; of equals the longest."""
    stats = {t: (n, c) for t, n, c, _ in candidates}
    chosen: dict[str, float] = {}
    for term, n, c, odds in candidates:
        stem = term.rstrip("*")
        if any(k.endswith("*") and stem.startswith(k.rstrip("*")) for k in chosen):
            continue
        # A longer term that covers nearly the same documents says the same with less risk.
        longer = [t for t, (m, d) in stats.items() if t.rstrip("*").startswith(stem) and len(t.rstrip("*")) > len(stem) and m >= 0.97 * n and d <= c]
        if longer:
            continue
        chosen[term] = odds
        if len(chosen) == TERMS:
            break
    # `word` and `word*` of the same word: the beginning covers both.
    return {t: w for t, w in chosen.items() if t.endswith("*") or t + "*" not in chosen}


def _phrases(text: str, hit: tuple) -> list[str]:
    """The hit's word with the one before it, and with the one after it."""
    a, b = hit[0], hit[1]
    while b < len(text) and text[b].isalpha():
        b += 1
    before = re.search(r"[^\W\d_]+ $", text[max(0, a - 40) : a])
    after = re.match(r" [^\W\d_]+", text[b : b + 40])
    return ([before[0] + text[a:b]] if before else []) + ([text[a:b] + after[0]] if after else [])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton's method; slopes are kept from turning negative."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge @ w / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge / 10
        step = np.linalg.solve(h, g)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``n_hits`` and ``terms`` (distinct terms hit, sorted).

    A null or empty text has no hits and the score that this gives. Repeated rows get equal results. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = pickle.loads(sent.value)
        a, e = own.automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1):
                    text = fold(t.as_py() or "")
                    hits = matches(text, a, e)
                    rows.append((_squash(own.curve, features(hits, len(text))), len(hits), sorted({h[3] for h in hits})))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string()))], names=["id", "score", "n_hits", "terms"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, "id long, score double, n_hits long, terms array<string>").withColumnRenamed("id", id_col)
