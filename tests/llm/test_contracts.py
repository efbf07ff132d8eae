"""The registered queries on the smallest tables: columns, types, rows, folds, and their values against plain versions."""

import hashlib
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from pagequery.llm.queries import QUERIES
from tests.llm.test_operators import brute_components, brute_windows

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
#: First columns of each query's result, with their types.
CONTRACT = {
    "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    held: dict = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, str(DATA))
            held[name] = (df.dtypes, df.collect())
        return held[name]

    return of


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(results, docs, name):
    kinds, rows = results(name)
    want = [tuple(c.split(" ")) for c in CONTRACT[name].split(", ")]
    assert kinds[: len(want)] == want
    ids = [r["doc_id"] for r in rows]
    assert set(ids) == set(docs) and (name == "op1_packing" or len(ids) == len(docs))
    folds = {"op2_toxicity": (5, 0), "op3_lm_score": (5, 1), "op6_language_id": (4, 2)}
    if name in folds:
        n, k = folds[name]
        assert all(r["held_out"] == (fold(r["doc_id"], n) == k) for r in rows)
    if "score" in dict(kinds) and name != "op3_lm_score":
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_packing(results, docs):
    from tokenizers import Tokenizer

    from pagequery.llm.tokens import default_path

    tok = Tokenizer.from_file(default_path())
    want = {}
    for i, d in docs.items():
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    rows = results("op1_packing")[1]
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def test_toxicity(results):
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in results("op2_toxicity")[1])


def test_lm_score(results, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (d["text"] or "").translate(lower)), None] for i, d in docs.items()}
    count: dict = {}
    for i, w in words.items():
        if fold(i, 5) != 1:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    gain = []
    for r in results("op3_lm_score")[1]:
        w = words[r["doc_id"]]
        base = sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), n) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        gain += [(r["score"] - base) / len(w)] if r["held_out"] else []
    assert np.mean(gain) > 0


def test_sharding(results, docs):
    rows = results("op4_sharding")[1]
    by: dict = {}
    for r in rows:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(24)) <= 1


def test_suffix_dedup(results, docs):
    ids = sorted(docs)
    texts = [(docs[i]["text"] or "").encode() for i in ids]
    got = {r["doc_id"]: r for r in results("op5_suffix_dedup")[1]}
    for i, data, marks in zip(ids, texts, brute_windows(texts, 200), strict=True):
        cover = np.zeros(len(data), dtype=bool)
        for a in np.flatnonzero(marks):
            cover[a : a + 200] = True
        kept = np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()
        runs = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_language_id(results, docs):
    rows = results("op6_language_id")[1]
    langs = {d["lang"] for d in docs.values() if d["lang"] is not None}
    assert {r["lang_pred"] for r in rows} <= langs | {"und"}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")) for r in rows)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert np.mean(held) > 0.9


def test_jaccard(results, docs):
    want = brute_components([(i, d["text"]) for i, d in docs.items()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in results("op10_jaccard")[1]} == want
