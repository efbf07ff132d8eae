"""The operators against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORDS = "the of and to in that was is for it with as his on be at by had are but from or have an they which one you were all her she there would their we him been has when who will no more".split()


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows, clash=True):
    """Documents with columns that operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    if not clash:
        return df
    return df.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("id", "t", "h", "n", "keep_id", "kept", "token", "row", "shard", "slot", "spans", "score", "rejected", "sequence_id", "lang", "g")])


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(n)]
    base = prose(rng, 300, [f"w{i}" for i in range(400)])
    near = base.split()
    near[50] = "changed"
    rows += [(n, base), (n + 1, base), (n + 2, " ".join(near)), (n + 3, None), (n + 4, ""), (n + 5, " \n\t "), (n + 6, "a"), (n + 7, prose(rng, 30_000)), (n + 8, "ab " * 400), (n + 9, base[:700] + " tail " + prose(rng, 9)), (n + 10, "É" * 150 + base[200:900])]
    return rows


EMPTY = []


# --- 7


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep):
    from pagequery.llm.exact_dedup import exact_dedup

    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup(table(spark, rows), keep=keep).collect()}
    best = min if keep == "min" else max
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best(same), len(same), i == best(same), hashlib.sha256((t or "").encode()).hexdigest())
    assert len(got) == len(rows)
    assert exact_dedup(table(spark, EMPTY)).count() == 0
    twice = exact_dedup(table(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "b")])).collect()
    assert len(twice) == 4 and sum(r["kept"] for r in twice if r["doc_id"] == 1) == 2


@given(st.lists(st.text(st.sampled_from("abZÉßİIJK'st<|12²٣.,! \n\t\x0b\x1c\x85\xa0\u0301\u0307\u030c\u2003\u3000文жΣς가\u200b\ufeff😀\x00\x7f_-") | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    from pagequery.llm.bytescan import slices
    from pagequery.llm.tokens import default_path, encoder

    texts = [*texts, "x" + texts[0] + "<|endoftext|>" + texts[-1], "İ.", " ".join(texts) * 3]
    e = encoder(default_path())
    for size in (1 << 20, 1):
        got = []
        for ids, data, offs in slices(pa.array(range(len(texts))), pa.array(texts), size):
            x, bounds = e.encode(data, offs)
            got += [x[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_with_a_full_cache(monkeypatch):
    from pagequery.llm import tokens as m

    monkeypatch.setattr(m, "CACHE", 40)
    monkeypatch.setattr(m, "LONG", 6)
    rng = random.Random(3)
    e = m.PieceEncoder(m.default_path())
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdé'") for _ in range(rng.choice([1, 3, 20]))) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        x, bounds = e.encode(data, offs)
        assert [x[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_null_id_leaves_others_alone():
    import pyarrow as pa

    from pagequery.llm.bytescan import slices

    ids = pa.array([None, 2**60 + 1, 3])
    assert pa.concat_arrays([i for i, _, _ in slices(ids, pa.array(["a", None, "b"]), 1)]).to_pylist() == [None, 2**60 + 1, 3]


def test_exact_dedup_survives_collisions(spark, monkeypatch):
    from pagequery.llm import exact_dedup as m

    monkeypatch.setattr(m.F, "md5", lambda c: F.lit("00" * 16))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in m.exact_dedup(table(spark, [(1, "a"), (2, "b"), (3, "a")]), keep="max").collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_exact_dedup_is_native(spark):
    from pagequery.llm.exact_dedup import exact_dedup

    plan = exact_dedup(table(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 1


def test_sum_of_squares():
    from pagequery.llm.packing import sum_of_squares

    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 3000)
    bins, offsets = sum_of_squares(sizes, 1000)
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at[0]] == 0 and np.array_equal(offsets[at][1:], np.cumsum(sizes[at])[:-1]) and sizes[at].sum() <= 1000
    assert bins.max() + 1 <= 1.017 * -(-sizes.sum() // 1000)  # the best-fit rule needs 1402 for these, at least 1380 are needed
    assert len(sum_of_squares(np.zeros(0, dtype=int), 10)[0]) == 0


@pytest.mark.parametrize("group", [1 << 16, 16])
def test_packing(spark, monkeypatch, group):
    from tokenizers import Tokenizer

    from pagequery.llm import packing as m
    from pagequery.llm.tokens import default_path

    monkeypatch.setattr(m, "GROUP", group)
    rows = [*corpus(), (90, "<|endoftext|> x"), (91, "don't STOP!!! İstanbul ΣΑΣ 12 naïve end")]
    tok = Tokenizer.from_file(default_path())
    placed = m.pack(table(spark, rows), capacity=256)
    got = placed.collect()
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 256
    total = sum(n for _, n, _ in want.values())
    assert len(by) <= 1.1 * -(-total // 256) + 1
    seqs = {r["sequence_id"]: r["ids"] for r in m.sequences(table(spark, rows), placed, capacity=256).collect()}
    assert {k: len(v) for k, v in seqs.items()} == {k: sum(n for _, n in p) for k, p in by.items()}
    assert m.pack(table(spark, EMPTY)).count() == 0


# --- 10


def brute_components(rows, k=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
            i += 1
    passage = [rng.choice(vocab) for _ in range(30)]
    rows += [(i + j, " ".join([f"u{j}{k}" for k in range(6)] + passage)) for j in range(12)]
    return rows


@pytest.mark.parametrize("seed,send", [(1, 10**6), (2, 10**6), (3, 0)])
def test_jaccard(spark, monkeypatch, seed, send):
    from pagequery.llm import jaccard as m
    from pagequery.llm import shared

    monkeypatch.setattr(m, "SEND", send)
    monkeypatch.setattr(shared, "SEND", send)
    monkeypatch.setattr(m, "BUCKETS", 1 << 12)
    rows = [*near_rows(seed), (900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "x " * 9000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [4096, 7])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    from pagequery.llm import jaccard as m

    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(5)
    body = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(body)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    sets = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(196)) for i, t in rows}
    classes = set(sets.values())
    want = {i: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in classes) for i, a in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in m.jaccard_components(table(spark, rows).repartition(3)).collect()}
    assert got == want and max(want.values()) > 10
    assert "n_links" not in m.jaccard_components(table(spark, rows), count_links=False).columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=50), min_size=2, max_size=40), st.integers(1, 39), st.integers(1, 100))
def test_link_counts(sets, cut_at, num):
    from pagequery.llm.jaccard import link_counts

    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    link = lambda x, y: 100 * len(x & y) >= num * len(x | y)
    assert link_counts(arrays, None, num, 100)[0].tolist() == [sum(i != j and link(x, y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    a, b = sets[:cut_at], sets[cut_at:]
    if b:
        left, right = link_counts(arrays[:cut_at], arrays[cut_at:], num, 100)
        assert left.tolist() == [sum(link(x, y) for y in b) for x in a] and right.tolist() == [sum(link(x, y) for x in a) for y in b]


def test_jaccard_repeated_and_null_ids(spark):
    from pagequery.llm.jaccard import jaccard_components

    a, b = "q w e r t y u i", "a b c d e f g h"
    rows = [(5, a), (5, a), (5, b), (None, b), (3, "z y x w v"), (None, "lone"), (9, a), (7, None), (7, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard_components(table(spark, rows).repartition(3)).collect())
    assert got == sorted([("5", 4, "5", 0)] * 3 + [("None", 4, "5", 0), ("3", 1, "3", 0), ("None", 1, "None", 0), ("9", 4, "5", 0)] + [("7", 0, "7", 0)] * 2)


def test_jaccard_empty(spark):
    from pagequery.llm.jaccard import jaccard_components

    assert jaccard_components(table(spark, EMPTY)).count() == 0
    assert {r["component_id"] for r in jaccard_components(table(spark, [(5, None), (6, "")])).collect()} == {5, 6}


def test_components(spark):
    from pagequery.llm.components import components

    links = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7), (60, 61), (61, 60)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8


@pytest.mark.parametrize("block,prints", [(10**6, 1 << 23), (60, 1 << 23), (60, 5)])
def test_decontaminate(spark, monkeypatch, block, prints):
    from pagequery.llm import decontaminate as m

    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "PRINTS", prints)
    rng = random.Random(3)
    items = [(j, prose(rng, rng.randint(1, 40), WORDS[:12])) for j in range(12)] + [(90, None), (91, ""), (92, "!!!"), (93, "Only Three words"), (94, "Only Three words")]
    docs = [(i, prose(rng, rng.randint(5, 200), WORDS[:12])) for i in range(25)] + [(50, None), (51, ""), (52, "only-three WORDS!"), (53, "é" + (items[3][1] or "")), (54, "x " * 20000 + items[5][1].upper())]
    docs += [(60 + j, "pre " + t + " post") for j, (_, t) in enumerate(items) if t]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for j, t in items:
        w = words(t)
        size = min(13, len(w))
        for a in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[a : a + size]), set()).add(str(j))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    docs.append((2**60 + 1, docs[3][1]))
    extra = table(spark, [*docs, (None, docs[5][1])]).repartition(3)
    got = {r["doc_id"]: r for r in m.decontaminate(extra, bench).collect()}
    assert got.pop(None)["items"] == got[5]["items"]
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if found := windows.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    names |= found
        r = got[i]
        assert (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) == (len(w), len(hit), sorted(names)), i
    assert len(got) == len(docs)
    assert m.decontaminate(table(spark, EMPTY), bench).count() == 0
    assert [r["items"] for r in m.decontaminate(table(spark, docs[:1]), bench.limit(0)).collect()] == [[]]


# --- 5


def brute_windows(parts, length):
    seen = {}
    for p in parts:
        for a in range(len(p) - length + 1):
            seen[p[a : a + length]] = seen.get(p[a : a + length], 0) + 1
    return [[seen[p[a : a + length]] > 1 for a in range(len(p) - length + 1)] for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 12))
def test_run_index(parts, length):
    from pagequery.llm.suffix_dedup import RunIndex, repeated

    parts = [p for p in parts if len(p) >= length] or [b"a" * length]
    covered = [np.zeros(len(p), dtype=bool) for p in parts]
    spans = [[] for _ in parts]
    for i, a, b in zip(*map(np.ndarray.tolist, repeated(parts, length)), strict=True):
        covered[i][a:b] = True
        spans[i].append((a, b))
    assert all(x[1] < y[0] for s in spans for x, y in itertools.pairwise(s))
    for c, marks in zip(covered, brute_windows(parts, length), strict=True):
        want = np.zeros(len(c), dtype=bool)
        for a in np.flatnonzero(marks):
            want[a : a + length] = True
        assert c.tolist() == want.tolist()
    sure = np.arange(len(parts)) % 2 == 0
    twice = repeated([*parts, *[p for p, s in zip(parts, sure, strict=True) if s]], length)
    again = repeated(parts, length, sure)
    keep = twice[0] < len(parts)
    assert all(x[keep].tolist() == y.tolist() for x, y in zip(twice, again, strict=True))
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8)
    index = RunIndex(text, max(map(len, parts)))
    assert index.lengths.sum() == len(text) and len(index.letters) <= len(text)


@pytest.mark.parametrize("length,many", [(200, 20_000), (40, 20_000), (40, 0)])
def test_repeated_spans(spark, length, many):
    from pagequery.llm.suffix_dedup import repeated_spans

    rows = corpus(5) + [(200 + i, "A" * 30 + f" {i} " + "shared passage number one, with enough bytes to be found again " * 1 + f"{i} tail " * 3) for i in range(8)]
    got = {r["doc_id"]: r for r in repeated_spans(table(spark, rows).repartition(3), length=length, many=many).collect()}
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), data, marks in zip(rows, texts, brute_windows(texts, length), strict=True):
        cover = np.zeros(len(data), dtype=bool)
        for a in np.flatnonzero(marks):
            cover[a : a + length] = True
        r = got[i]
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        runs = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        assert (r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), r["kept_sha256"]) == (len(data), int(cover.sum()), hashlib.sha256(kept).hexdigest()), i
        assert len(r["spans"]) == runs
    assert repeated_spans(table(spark, EMPTY)).count() == 0
    rng = random.Random(1)
    one, other = prose(rng, 60), prose(rng, 60)
    same = repeated_spans(table(spark, [(1, one), (1, one), (1, other), (None, other), (None, None), (2, prose(rng, 60))]).repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], len(r["spans"])) for r in same) == sorted([("1", len(one), 1)] * 2 + [("1", len(other), 1), ("None", len(other), 1), ("None", 0, 0), ("2", [r["n_bytes"] for r in same if r["doc_id"] == 2][0], 0)])


# --- 4


@pytest.mark.parametrize("shards,hot", [(24, 150), (3, 0), (7, 400)])
def test_sharding(spark, shards, hot):
    from pagequery.llm.sharding import shard

    rng = random.Random(9)
    rows = [(i, prose(rng, 4)) for i in range(200)] + [(1000 + i, "hot") for i in range(hot)] + [(5000 + i, f"group {i // 5}") for i in range(100)] + [(6000, None), (6001, "")]
    got = shard(table(spark, rows), shards=shards).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    count, slots, where = {}, {}, {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        count[r["shard"]] = count.get(r["shard"], 0) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(t, []).append(r["shard"])
    assert len(count) == shards and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = [v for t, v in where.items() if 1 < len(v) <= 6]
    assert sum(len(set(v)) == 1 for v in small) >= 0.8 * len(small)
    if hot and shards == 7:
        assert len(set(where["hot"])) <= -(-hot * shards // len(rows)) + 2


def test_sharding_small(spark):
    from pagequery.llm.sharding import admitted, shard

    assert shard(table(spark, EMPTY)).count() == 0
    assert sorted(r["slot"] for r in shard(table(spark, [(1, "a"), (1, "a"), (2, "b")]), shards=24).collect()) == [0, 0, 0]
    x = admitted(np.array([[0.0, 9.0], [2.0, 0.0]]), np.array([5.0, 5.0]), np.array([6.0, 6.0]))
    assert x.sum() > 2 and (np.array([5.0, 5.0]) + x.sum(axis=0) - x.sum(axis=1) <= 6 + 1e-6).all()


# --- 9


def test_warc(spark, monkeypatch):
    import pyarrow.fs as pafs

    from pagequery.llm import warc as m

    monkeypatch.setattr(m, "FRAME", 2000)
    monkeypatch.setattr(m, "BUNDLE", 1500)
    rng = random.Random(4)
    long = prose(rng, 300)
    rows = [(i, f"http://h/{i}", prose(rng, rng.randint(1, 200))) for i in range(30)] + [(100, "http://h/%0A\n\r x", long), (101, None, long), (102, "u", long), (103, "u", "short"), (104, "u", "short"), (105, "u", None), (106, "u", "é\r\n\r\nWARC/1.1\r\n"), (107, "u", prose(rng, 40_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit("x"), "p": F.lit(1), "to": F.lit(2), "h": F.lit(3)})
    uri, index = m.write(pages.repartition(2))
    got = {r["id"]: r for r in m.read_records(uri, index).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        data, r = (html or "").encode(), got[i]
        refers = 102 if i in (100, 101) else None
        assert (r["kind"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["url"]) == ("revisit" if refers else "response", refers, len(data), hashlib.sha1(data).hexdigest(), url or "")
        assert r["payload"] == (None if refers else html or "")
    # The seek table and the index agree, and every frame stands alone.
    import zstandard

    fs, root = pafs.FileSystem.from_uri(uri)
    for b in {r["bundle"] for r in index.collect()}:
        frames = m.seek_table(fs, f"{root}/{b}")
        raw = fs.open_input_file(f"{root}/{b}").read()
        assert {r["frame"] for r in index.collect() if r["bundle"] == b} == set(range(len(frames)))
        assert b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + c]) for a, c, _, _ in frames).startswith(b"WARC/1.1")
        assert raw[-4:] == m.struct.pack("<I", m.SEEKABLE_MAGIC)
    # Ids are the records' own: an index that names others is found out.
    with pytest.raises(Exception, match="where record"):
        m.read_records(uri, index.withColumn("id", F.col("id") + 1)).collect()
    # Rows with a null id, and an id with two payloads.
    odd = spark.createDataFrame([(None, "u", long), (1, "u", long), (2, "u", long), (2, "u", "short"), (1, "u", "short")], "page_id long, url string, html string")
    got = sorted((str(r["id"]), r["kind"], r["payload_bytes"], r["refers_to"]) for r in m.read_records(*m.write(odd)).collect())
    size = len(long.encode())
    assert got == sorted([("None", "response", size, None), ("1", "revisit", size, 2), ("2", "response", size, None), ("2", "response", 5, None), ("1", "response", 5, None)])
    uri, index = m.write(pages.limit(0))
    assert index.count() == 0 and m.read_records(uri, index).count() == 0
    with pytest.raises(ValueError):
        m.parse(b"HTTP/1.1 200\r\n\r\n")


# --- 2


def test_toxicity(spark):
    from pagequery.llm.toxicity import Lexicon, fold, learn, matches, score

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grumbler", "nitwit", "dolt" + rng.choice(["ish", "ery", "s"])])
        rows.append((i, " ".join(words)))
        labels.append((i, None if i == 7 else int(toxic)))
    labels_df = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = learn(table(spark, rows), labels_df.where("doc_id % 5 <> 0"))
    assert any(t.startswith("nitwit") for t in lexicon.terms) and len(lexicon.terms) < 20
    test = [*rows, (900, None), (901, ""), (902, "n1tw1t и gгumbler NITWIT"), (903, "word " * 50_000), (904, "the nitwits"), (905, "unitwit")]
    got = {r["doc_id"]: r for r in score(table(spark, test), lexicon).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels if y is not None and i % 5 == 0)
    assert got[902]["score"] >= 0.5 and got[902]["n_hits"] == 3 and got[904]["n_hits"] == 1 and got[905]["n_hits"] == 0
    assert got[900]["score"] == got[901]["score"] < 0.5 and 0 <= got[903]["score"] < 0.5 and len(got) == len(test)
    assert score(table(spark, EMPTY), lexicon).count() == 0
    assert learn(table(spark, EMPTY), labels_df).terms == {} and learn(table(spark, rows), labels_df.limit(0)).terms == {}
    a, e = Lexicon({"bad": 1.0}, ["not bad"]).automaton()
    assert [m[3] for m in matches(fold("Bad, not bad, b4d, badly"), a, e)] == ["bad", "bad"]
    assert fold("ｉｄ１ＯＴ ѕсum p​at") == "idiot scum pat"


def test_toxicity_against_a_plain_matcher(spark):
    from pagequery.llm.toxicity import Lexicon, features, fold, score

    rng = random.Random(11)
    lexicon = Lexicon({"nitwit": 2.0, "dolt*": 1.5, "dolt": 0.5, "grumb*": 1.0, "ass": 3.0}, ["not nitwit", "ass of one dolt", "the dolts"], (-2.0, 0.8, 0.5))
    parts = ["nitwit", "dolt", "doltish", "dolts", "grumbler", "ass", "assume", "not", "of", "one", "the", "N1TWIT", "d0lt", "a$s", "аss", "x"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(2**60 + 1, "nitwit"), (None, "dolt"), (900, "ass of one dolt " * 20_000)]
    got = {r["doc_id"]: r for r in score(table(spark, rows), lexicon).collect()}
    for i, t in rows[:-1]:
        text, hits = fold(t), []
        covered = [(a, a + len(p)) for p in lexicon.exceptions for a in range(len(text)) if text.startswith(p, a)]
        for a in range(len(text)):
            if a and text[a - 1].isalpha():
                continue
            best = None
            for term, w in lexicon.terms.items():
                b = a + len(term.rstrip("*"))
                if text.startswith(term.rstrip("*"), a) and (term.endswith("*") or not text[b : b + 1].isalpha()) and (best is None or b >= best[1]):
                    if best is None or b > best[1] or term.endswith("*"):
                        best = (a, b, w, term)
            if best and not any(x <= best[0] and best[1] <= y for x, y in covered):
                hits.append(best)
        assert got[i]["n_hits"] == len(hits), (t, hits)
        if not {h[3] for h in hits} & {"dolt", "dolt*"}:
            f = features(hits, len(text))
            assert abs(got[i]["score"] - 1 / (1 + np.exp(2.0 - 0.8 * f[0] - 0.5 * f[1]))) < 1e-9
    assert got[900]["n_hits"] == 0 and got[None]["n_hits"] == 1 and got[2**60 + 1]["terms"] == ["nitwit"]


# --- 3


def test_lm(spark):
    from pagequery.llm import lm_score as m

    rng = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(120)] for p in "abc"]
    rows = [(i, prose(rng, rng.randint(5, 80), tongues[i % 3]).replace("a1", "A1")) for i in range(300)] + [(900, None), (901, ""), (902, "new words here"), (903, "a1 " * 30_000), (904, "a1 a1")]
    train = [r for r in rows if r[0] % 5]
    model, counts = m.fit(table(spark, train))
    got = {r["doc_id"]: r for r in m.score(table(spark, rows), model, counts).collect()}
    from collections import Counter

    lower = lambda t: (t or "").lower().split() + ["\n"]
    c = Counter(w for _, t in train for w in lower(t))
    n = sum(c.values())
    z = n + 0.5 * (len(c) + 1)
    gain = 0.0
    for i, t in rows:
        r, w = got[i], lower(t)
        base = sum(np.log10((c[x] + 0.5) / z) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n) and abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        gain += (r["score"] - base) if i % 5 == 0 and i < 300 else 0
    assert gain > 0 and len(got) == len(rows)
    # Scores of whole texts from the model's definition, token by token, each context's probabilities summed over the whole vocabulary.
    from pagequery.llm.bytescan import slices

    x, lay = model.state, model.layout
    import pyarrow as pa

    for i, t in [(i, t) for i, t in rows if i % 17 == 0][:15] + [(900, None), (902, "new words here")]:
        ids, data, offs = next(slices(pa.array([i]), pa.array([t], pa.string())))
        h = m.tokens(data, offs)[0]
        cls, total = lay.classes(h), 0.0
        for j, w in enumerate(cls):
            before = x.r[cls[max(0, j - m.SPAN) : j]].astype(float)
            context = before.sum(axis=0) / m.SPAN * x.gain[0] + (before[-1] if j else 0) * x.gain[1]
            group = np.exp(x.s.astype(float) @ context) * lay.shares
            block = np.flatnonzero(lay.group == lay.group[w])
            word = np.exp(x.q[block].astype(float) @ context) * lay.unigram[block]
            p = group[lay.group[w]] / group.sum() * (word[block == w][0] / word.sum() if w < len(lay.vocab) else 1)
            own = np.log10(m.TRUST * p + (1 - m.TRUST) * lay.unigram[w])
            total += own + (np.log10(c.get((lower(t) + [""])[j], 0) + 0.5) - model.others if w == len(lay.vocab) else 0)
        assert abs(got[i]["score"] - total) < 1e-4 * abs(total) + 1e-6
    every = model.every(np.random.default_rng(0).normal(0, 2, (50, m.WIDTH)).astype(np.float32))
    assert np.allclose(every.sum(axis=1), 1, atol=1e-4) and (every > 0).all()
    assert m.score(table(spark, EMPTY), model, counts).count() == 0
    model, counts = m.fit(table(spark, EMPTY))
    r = m.score(table(spark, [(1, "a b")]), model, counts).first()
    assert (r["train_tokens"], r["base_score"], r["score"]) == (0, 0.0, 0.0)


def test_lm_trains_on_all_texts_and_whole_ones(spark, monkeypatch):
    import pyarrow as pa

    from pagequery.llm import lm_score as m

    monkeypatch.setattr(m, "SAMPLE", 0)
    monkeypatch.setattr(m, "FEW", 1)
    monkeypatch.setattr(m, "LEAST", 20)
    rng = random.Random(3)
    tongues = [[f"{p}{i}" for i in range(120)] for p in "abc"]
    model, _ = m.fit(table(spark, [(i, prose(rng, rng.randint(40, 80), tongues[i % 3])) for i in range(300)]).repartition(3))
    # The end of a text is in no context.
    k = len(model.layout.vocab)
    fresh = m.start(k + 1, model.layout.groups + 1)
    moved = [np.abs(getattr(model.state, x) - getattr(fresh, x)).sum(axis=1) > 0 for x in "rqs"]
    assert k > 300 and moved[0][:-1].sum() >= k - 1 and moved[1][:-1].all() and moved[2][:-1].all()
    long = m._classes(type("Sent", (), {"value": m.pickle.dumps(model.layout)}))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a1 " * 5_000])], names=["id", "t"])
    assert len(next(long(iter([batch]))).column(0)[0].as_py()) == 4 * 5_001


def test_lm_rare_words_meet_their_counts(spark, monkeypatch):
    from pagequery.llm import lm_score as m

    monkeypatch.setattr(m, "HEAD", 4)
    monkeypatch.setattr(m, "WORDS", 2)
    rows = [(1, "x x x x y y z"), (2, "x y q q"), (2, "x y q q")]
    model, counts = m.fit(table(spark, rows[:2]))
    got = m.score(table(spark, rows), model, counts).collect()
    assert len(model.head) <= 4 and len(got) == 3 and got[0]["n_known"] == 8


# --- 6


def test_language_id(spark):
    from pagequery.llm.language_id import fit, identify, verdict

    rng = random.Random(6)
    tongues = {"xx": ["ba", "bo", "lum", "dor", "bli"], "yy": ["éké", "iru", "üsta", "ñol", "zaq"]}
    make = lambda lang, n: " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make("xx" if i % 2 else "yy", rng.randint(3, 60)), "xx" if i % 2 else "yy") for i in range(200)]
    train = spark.createDataFrame([*rows, (500, None, "xx"), (501, "abc", None), (502, "", "yy")], "doc_id long, text string, lang string").withColumns({"id": F.lit(0), "t": F.lit(0), "o": F.lit(1), "r": F.lit(2)})
    model = fit(train)
    test = [(1000 + i, make("xx" if i % 2 else "yy", 8).upper()) for i in range(60)] + [(1, None), (2, ""), (3, "12 !? 34"), (4, make("xx", 20_000)), (5, "汉字汉字 " * 40), (6, "b")]
    got = {r["doc_id"]: r for r in identify(table(spark, test), model).collect()}
    assert np.mean([got[1000 + i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(60)]) > 0.95
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "xx" and not got[4]["rejected"] and got[5]["rejected"] and not got[6]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[1000 + i]["rejected"] for i in range(60))
    docs = table(spark, test)
    kept = {r["doc_id"] for r in docs.where(~verdict(spark, model)("text")).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}
    assert identify(table(spark, EMPTY), model).count() == 0
    assert fit(train.limit(0)) is None and identify(table(spark, [(1, "abc")]), None).first()["lang_pred"] in ("und",)


def test_language_rejection_is_calibrated(spark):
    from pagequery.llm.language_id import fit, identify

    rng = random.Random(7)
    tongues = {"xx": ["ba", "bo", "lum", "dor", "bli", "sen", "tor"], "yy": ["éké", "iru", "üsta", "ñol", "zaq", "mée"]}
    make = lambda lang: " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(400)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    noise = lambda: " ".join("".join(rng.sample(make("xx").replace(" ", "")[:12], 9)) for _ in range(30))
    test = [(1000 + i, make("xx" if i % 2 else "yy")) for i in range(200)] + [(2000 + i, noise()) for i in range(50)] + [(3000, "жили были дед да баба " * 5), (2**60 + 1, make("xx")), (None, make("yy"))]
    got = {r["doc_id"]: r for r in identify(table(spark, test), model).collect()}
    assert sum(got[1000 + i]["rejected"] for i in range(200)) <= 1 and sum(got[2000 + i]["rejected"] for i in range(50)) >= 45 and got[3000]["rejected"]
    assert got[2**60 + 1]["lang_pred"] == "xx" and got[None]["lang_pred"] == "yy"


def test_kneser_ney_by_definition():
    """Probabilities of n-grams from their definition, counted in dictionaries."""
    from pagequery.llm import language_id as m

    texts = ["abracadabra abba a cab", "cabbage bag abracadabra", "a dab bad cab"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, bounds, _ = m.stream(data, offs)
    docs = [s[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    alphabet = 40
    got = m.kneser_ney(m._counts([t.encode() for t in texts]), alphabet)
    seen = [{tuple(d[i - n : i + 1]) for d in docs for i in range(max(n, 1), len(d))} for n in range(m.ORDER)]
    hashed = m.hashes(s, m.ORDER)
    name = [{int(hashed[n][a + i]): tuple(s[a + i - n : a + i + 1].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(max(n, 1), b - a)} for n in range(m.ORDER)]
    lower: dict = {}
    for n in range(m.ORDER):
        if n == m.ORDER - 1:
            c = {g: sum(tuple(d[i - n : i + 1]) == g for d in docs for i in range(max(n, 1), len(d))) for g in seen[n]}
        else:
            c = {g: max(1, len({h[0] for h in seen[n + 1] if h[1:] == g})) for g in seen[n]}
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)
        p = {}
        for g, v in c.items():
            after = [w for h, w in c.items() if h[:-1] == g[:-1]]
            p[g] = max(v - d, 0) / sum(after) + d * len(after) / sum(after) * (lower.get(g[1:], 1 / alphabet) if n else 1 / alphabet)
        u, probs, _ = got[n]
        assert {name[n][int(h)]: round(float(x), 12) for h, x in zip(u, probs, strict=True)} == {g: round(x, 12) for g, x in p.items()}
        lower = p


def test_sharding_goes_on_after_a_round_of_few_moves(spark):
    from pagequery.llm import sharding as m
    from pagequery.llm.shared import cut

    # Group y leaves shard 1, which then has room for the rest of x.
    cells = [("a", 0, 5000), ("b", 1, 9769), ("y", 0, 21), ("y", 1, 20), ("x", 0, 5), ("x", 1, 20)]
    frame = cut(spark.createDataFrame(cells, "h string, shard int, n long"), "cells")
    got = {(r["h"], r["shard"]): r["n"] for r in m._propagate(frame, 2, np.array([20000, 10000]), m.ROUNDS).collect()}
    assert got == {("a", 0): 5000, ("b", 1): 9769, ("y", 0): 41, ("x", 1): 25}
