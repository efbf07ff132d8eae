"""Jaccard self-join over word n-grams with adaptive multi-match prefixes.

Shingles of a document are ordered by estimated frequency, rare first. With prefix length ``n - ceil(t n) + m`` two documents
that link share at least m prefix tokens, m being the smaller of their two choices. Each document
chooses its own m: where its prefix holds frequent tokens, a longer prefix that demands more matches costs less than the
candidates it avoids. The frequencies come from a count sketch of fixed size over all shingles; they steer
cost only, since any order that depends on the token alone gives the same links.

Documents with the same set are one class from the start. Candidates then come in two rounds. In the first, each
token's documents are compared with a few of them (linear in the list). In the second, pairs of a token's documents are made only where
they lie in different components by then, so a group of thousands of near copies never becomes all its
pairs; and tokens with long lists are left out wherever the other tokens must show matches too. Candidates pass a bound on the symmetric difference from parity signatures, and then an exact comparison of the whole sets.

The links of a class all lie in its component. They are counted there in blocks of bounded size: each pair of a component's blocks goes to a task, which counts
what the sets share in matrices and returns a number a class. No pair becomes a row; a component of one block, as most are, travels once.

Shingles are compared as 64-bit hashes, and sets count as equal when their sizes and two 64-bit sums over the hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytescan import LOWER, SPACED, grams, mix, slices, words
from .components import components
from .shared import SEND, cut, forget, unique_ids, without

#: Largest number of matches that a document may demand.
MOST = 5
#: Cost of comparing two documents against that of reading one entry of a token's list.
COMPARE = 12.0
#: Matches demanded of every pair whose sizes leave room for them in the prefixes as they are.
FREE = 5
#: Documents that each token's others are compared with in the first round.
STARS = 3
#: Entries above which a token is heavy in the second round.
HEAVY = 6
#: Classes and shingles of a block in which links are counted, on average.
BLOCK = 2048
SHINGLES = 1 << 20
#: Classes that share a token, up to which their pairs are counted one by one; others by a product of matrices.
FEW = 16
#: Buckets of the frequency sketch (a power of two); 4 bytes each in a counting task, 1 byte in a reading one.
BUCKETS = 1 << 22


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, repeats included, and the offsets of documents in them."""
    w = words(LOWER[data], offs, SPACED)
    count = w.count
    g = grams(w.hash, k)
    at = np.arange(len(g))
    inside = at + k <= w.last_of_doc()[: len(g)]
    made = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    out_count = made + ((count > 0) & (count < k))
    bounds = np.concatenate([[0], np.cumsum(out_count)])
    out = np.empty(bounds[-1], dtype=np.uint64)
    mask = np.ones(len(out), dtype=bool)
    mask[bounds[short]] = False
    out[mask] = g[inside]
    for d in short:
        out[bounds[d]] = grams(w.hash[w.first[d] : w.first[d + 1]], int(count[d]))[0]
    return out, bounds


def prefix_base(n: int, num: int, den: int) -> int:
    """Prefix length for one match: n - ceil(n num / den) + 1."""
    return n - -(-n * num // den) + 1


def _sketch(slim: DataFrame, k: int) -> np.ndarray:
    """Frequency class of every bucket, as a byte; 0 where nothing stands out. Its size doesn't depend on the input."""
    parts, size = 64, BUCKETS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int32)
        held, size_held = [], 0
        for batch in batches:
            for _, data, offs in slices(batch.column(0), batch.column(1)):
                held.append((shingles(data, offs, k)[0] & np.uint64(BUCKETS - 1)).astype(np.int32))
                size_held += len(held[-1])
                if size_held > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.int32)
                    held, size_held = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.int32)
        blobs = [zlib.compress(total[i * size : (i + 1) * size].tobytes(), 1) for i in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in table:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), dtype=np.int32)
                sums[part] = sums[part] + x if part in sums else x.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = slim.mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).collect()
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        total[r["part"] * size : (r["part"] + 1) * size] += np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
    usual = float(np.median(total))
    above = np.maximum(total - usual - 4 * np.sqrt(usual + 1), 0)
    return np.minimum(np.round(8 * np.log2(1 + above)), 255).astype(np.uint8)


_ROW = pa.schema([
    ("id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("m", pa.int32()), ("base", pa.int32()),
    ("tokens", pa.list_(pa.int64())), ("sig", pa.binary()),
])


def _rows_kernel(sent, k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, dtype=np.uint8)
        weight = 2.0 ** (np.arange(256) / 8.0) - 1  # entries that a class stands for
        seen: set = set()
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                h, bounds = shingles(data, offs, k)
                out = []
                for d in range(len(ids)):
                    u = np.unique(h[bounds[d] : bounds[d + 1]])
                    n = len(u)
                    spread = mix(u)
                    key = (n, int(np.sum(spread).view(np.int64)) if n else 0, int(np.sum(mix(spread)).view(np.int64)) if n else 0)
                    if not n or key in seen:  # a copy of a set that this task has sent already
                        out.append((*key, 0, 0, None, None))
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    lev = level[u & np.uint64(BUCKETS - 1)]
                    order = np.argsort((lev.astype(np.uint64) << np.uint64(56)) | (spread >> np.uint64(8)))
                    base = prefix_base(n, num, den)
                    most = max(1, min(MOST, -(-n * num // den)))
                    m = 1
                    if lev[order[min(n, base) - 1]]:  # the rarest tokens don't fill the prefix
                        f = np.cumsum(weight[lev[order[: base + most - 1]]])
                        want = np.arange(1, most + 1)
                        sums = f[np.minimum(base + want - 2, len(f) - 1)]
                        m = int(np.argmin(base + want - 1 + sums * (1 + COMPARE / want))) + 1
                    bits = 1 << min(15, max(6, int(2 * n - 1).bit_length()))
                    odd = np.bincount((spread & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    out.append((*key, m, base, u[order[: base + m - 1]].view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()))
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                arrays = [ids, *(pa.array(c, f.type) for c, f in zip(cols, list(_ROW)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=_ROW)

    return run


def _could_link(na: int, sa: bytes, nb: int, sb: bytes, num: int, den: int) -> bool:
    """Whether the parities leave room: they differ in no more bits than the sets differ in elements."""
    a, b = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
    if len(a) != len(b):  # fold the longer one
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    apart = int(np.bitwise_count(a ^ b).sum())
    # |A & B| = (na + nb - apart) / 2 at most and |A | B| = na + nb minus that.
    return den * (na + nb - apart) >= num * (na + nb + apart)


def _verify_signature(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            ok = [_could_link(na, sa, nb, sb, num, den) for _, _, na, nb, sa, sb in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify_text(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in kept:
                if len(kept) >= 64:
                    kept.clear()
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                kept[i] = np.unique(shingles(data, np.array([0, len(data)]), k)[0])
            return kept[i]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, y = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True
) -> DataFrame:
    """One row per document: id, ``n_shingles`` (long), ``component_id`` (smallest id reachable over links, its own included) and, with ``count_links``, ``n_links``
    (links of its class of equal sets with other classes, all of them).

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``k``-word shingles. Null and empty texts and those without words have no
    shingles and link with nothing, not even with each other; a text of fewer than ``k`` words is one shingle. Rows that repeat, or share an id, are documents of their own and each get
    their result; a document with a null id has the smallest id of its group that isn't null, or null. An empty table gives no rows. Other columns are ignored.
    """
    slim, own = unique_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")))
    out = _components(slim, k, num, den, count_links)
    if own is not None:
        out = cut(out.join(own, "id"), "numbered")
        least = out.groupBy("component_id").agg(F.min("own").alias("least"))
        rest = [c for c in out.columns if c not in ("id", "own", "component_id", "n_shingles")]
        out = out.join(least, "component_id").select(F.col("own").alias("id"), "n_shingles", F.col("least").alias("component_id"), *rest)
    return out.withColumnRenamed("id", id_col)


def _components(slim: DataFrame, k: int, num: int, den: int, count_links: bool) -> DataFrame:
    """``jaccard_components`` for rows (id, t) with ids that are unique and not null."""
    spark = slim.sparkSession
    sent = spark.sparkContext.broadcast(_sketch(slim, k).tobytes())
    sets = cut(slim.mapInArrow(_rows_kernel(sent, k, num, den), "id long, n int, h1 long, h2 long, m int, base int, tokens array<long>, sig binary"), "sets")
    # Classes of equal sets; the representative is one of those that sent tokens.
    key = ["n", "h1", "h2"]
    classes = sets.where("n > 0").groupBy(key).agg(F.min("id").alias("low"), F.min(F.expr("if(tokens is null, null, id)")).alias("rep"))
    meta = sets.select("id", *key, F.col("tokens").isNotNull().alias("sent"))
    labels = cut(meta.join(classes, key, "left").select("id", "n", "low", "rep", "sent"), "labels")
    # A class that several tasks met was sent as often; one of them is kept.
    tokens = without(sets.where("tokens is not null").select("id", "n", "m", "tokens"), labels.where("sent and id <> rep").select("id"), "id")
    tokens = tokens.select("id", "n", "m", F.posexplode("tokens").alias("at", "token"))
    # Size, matches and place in one number: rows of the widest shuffle are three longs.
    meta = F.shiftleft(F.shiftleft(F.col("n").cast("long"), 3) + F.col("m"), 28) + F.col("at")
    tokens = tokens.select("token", "id", meta.alias("meta"))
    over = Window.partitionBy("token")
    tokens = tokens.repartition("token")  # the orders below are made after the shuffle, not carried through it
    # A document that a token comes early in has few tokens of its own, so it lies in the middle of the group that shares the token.
    at = F.col("meta").bitwiseAND(F.lit((1 << 28) - 1))
    order = [F.struct(F.floor(at / (1 << r)), F.xxhash64("id", F.lit(r))) for r in range(STARS)]
    tokens = tokens.withColumns({f"o{r}": o for r, o in enumerate(order)})
    tokens = tokens.withColumns({"low": F.min("id").over(over), "high": F.max("id").over(over), **{f"p{r}": F.min_by("id", f"o{r}").over(over) for r in range(STARS)}, **{f"q{r}": F.min_by("meta", f"o{r}").over(over) for r in range(STARS)}})
    tokens = cut(tokens.where("low <> high").drop("low", "high", *[f"o{r}" for r in range(STARS)]), "tokens")
    stars = F.array_distinct(F.array(*[F.struct(F.col(f"p{r}").alias("id2"), F.col(f"q{r}").alias("meta2")) for r in range(STARS)]))
    first = tokens.select("id", "meta", F.explode(stars).alias("s")).select("id", "meta", "s.*").where("id <> id2")
    first = cut(_candidates(first, num, den, "least(2 * c, c + 4) >= m").distinct(), "pairs")
    links = cut(_verified(first, sets, slim, k, num, den), "links")
    comp = cut(components(links), "comp")

    rows = tokens.select("token", "id", "meta").join(comp, "id", "left").select("token", "id", "meta", F.coalesce("root", "id").alias("c"))
    rows = rows.withColumns({"lo": F.min("c").over(over), "hi": F.max("c").over(over)}).where("lo <> hi").select("token", "id", "meta", "c")
    rows = rows.withColumn("heavy", F.count(F.lit(1)).over(over) > HEAVY)
    rows = cut(rows, "apart")
    crowd = rows.where("heavy").groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    rows = cut(rows.join(crowd, "id", "left").withColumn("d", F.coalesce("d", F.lit(0))), "rows")
    other = rows.select("token", *[F.col(x).alias(x + "2") for x in ("id", "meta", "c", "d")])
    apart = "c <> c2 and id < id2"
    # Pairs with more matches to show than heavy tokens show them in the light ones; their lists are short.
    light = _candidates(rows.where("not heavy").join(other, "token").where(apart), num, den, None)
    dense = _candidates(rows.where("d > 0").join(other.where("d2 > 0"), "token").where(apart), num, den, "c >= m", heavy=True)
    second = light.unionByName(dense).distinct().join(first, ["a", "b"], "left_anti")
    more = cut(_verified(cut(second, "pairs"), sets, slim, k, num, den), "links")
    if more.isEmpty():
        found = comp
    else:
        star = comp.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        found = cut(components(star.unionByName(more)), "comp")
    for used in (tokens, rows):
        forget(used)

    lows = labels.where("id = rep").select("rep", "low").join(found.withColumnRenamed("id", "rep"), "rep")
    lowest = lows.groupBy("root").agg(F.min("low").alias("component"))
    by_rep = lows.join(lowest, "root").select("rep", "component")
    columns = ["id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "low", "id").alias("component_id")]
    if count_links:
        by_rep = by_rep.join(_degrees(found, labels, slim, k, num, den), "rep", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return labels.join(by_rep, "rep", "left").select(*columns)


def link_counts(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of different classes: how many of ``b`` each of ``a`` links with, and the other way round; without ``b``, among themselves."""
    every = a if b is None else [*a, *b]
    n = np.array([len(x) for x in every])
    across = np.arange(len(a)) if b is None else len(a) + np.arange(len(b))
    token, owner = np.concatenate(every), np.repeat(np.arange(len(every)), n)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    times = np.diff(np.append(first, len(token)))
    width = len(across)
    shared = np.zeros((len(a), width), dtype=np.int32)
    codes: list[np.ndarray] = []

    def tally() -> None:
        nonlocal shared
        if codes:
            shared += np.bincount(np.concatenate(codes), minlength=shared.size).astype(np.int32).reshape(shared.shape)
            codes.clear()

    for d in range(2, FEW + 1):
        at = first[times == d]
        for part in range(0, len(at), 1 << 16):
            rows = owner[at[part : part + (1 << 16), None] + np.arange(d)]
            for i in range(d):
                for j in range(d):
                    x, y = rows[:, i], rows[:, j]
                    if i != j and b is None:
                        codes.append(x * width + y)
                    elif i < j:  # owners are in order, those of ``b`` last
                        ok = (x < len(a)) & (y >= len(a))
                        codes.append(x[ok] * width + y[ok] - len(a))
            if sum(map(len, codes)) > 4_000_000:
                tally()
    tally()
    often = np.flatnonzero(times > FEW)
    for part in range(0, len(often), 1024):
        some = often[part : part + 1024]
        at = np.repeat(first[some] - (np.cumsum(times[some]) - times[some]), times[some]) + np.arange(times[some].sum())
        has = np.zeros((len(every), len(some)), dtype=np.float32)
        has[owner[at], np.repeat(np.arange(len(some)), times[some])] = 1
        shared += (has[: len(a)] @ has[across].T).astype(np.int32)
    # den * shared >= num * (total - shared)
    link = np.empty(shared.shape, dtype=bool)
    for i in range(len(a)):
        link[i] = (num + den) * shared[i].astype(np.int64) >= num * (n[i] + n[across])
    if b is None:
        np.fill_diagonal(link, False)
    return link.sum(axis=1), link.sum(axis=0)


def _degrees(found: DataFrame, labels: DataFrame, slim: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of each class that has any: ``rep``, ``n_links``."""
    members = cut(labels.where("id = rep").select("id", "n").join(found, "id"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    per = cut(members.groupBy("root").agg(blocks.alias("blocks")), "blocks")
    few = members.count() <= SEND
    members = members.join(F.broadcast(per) if few else per, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = slim.join(F.broadcast(members) if few else members, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["root", "lo", "hi"]
    texts = texts.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block", "t")
    dealt = texts.repartition(*key).sortWithinPartitions(*key, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        now: tuple | None = None

        def count() -> pa.RecordBatch:
            if now[1] == now[2]:
                ids, links = held[0], link_counts(held[1], None, num, den)[0]
            elif held[0] and held[2]:
                ids, links = held[0] + held[2], np.concatenate(link_counts(held[1], held[3], num, den))
            else:
                ids, links = [], np.zeros(0)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["rep", "n"])
            for x in held:
                x.clear()
            return out

        for batch in batches:
            for root, lo, hi, i, block, text in zip(*batch.columns, strict=True):
                at = (root.as_py(), lo.as_py(), hi.as_py())
                if at != now:
                    if now is not None:
                        yield count()
                    now = at
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                side = 2 if block.as_py() != at[1] else 0
                held[side].append(i.as_py())
                held[side + 1].append(np.unique(shingles(data, np.array([0, len(data)]), k)[0]))
        if now is not None:
            yield count()

    return dealt.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def _candidates(pairs: DataFrame, num: int, den: int, enough: str | None, heavy: bool = False) -> DataFrame:
    """Pairs of fitting sizes that share as many prefix tokens as they must.

    A pair that links shares ``need`` tokens or more, so its prefixes of length ``n - need + m`` share m, for any m that the prefixes allow. The prefixes that
    documents sent are made for the smallest partner; with one of like size they allow ``most``, which is more than either's own m. ``enough``
    is the condition on m and the matches ``c``. Without it only light tokens are in the table: of ``most`` matches all but the heavy tokens of either
    side are among them. Pairs that this leaves nothing to ask of come with ``heavy``, and those alone, from all tokens.
    """
    p = {}
    for k in ("", "2"):
        n, m, at = f"shiftright(meta{k}, 31)", f"(shiftright(meta{k}, 28) & 7)", f"(meta{k} & {(1 << 28) - 1})"
        p |= {f"n{k}": n, f"m{k}": m, f"at{k}": at, f"p{k}": f"({n} - ({n} * {num} + {den - 1}) div {den} + {m})"}
    need = f"(({num} * ({p['n']} + {p['n2']}) + {num + den - 1}) div {num + den})"
    most = f"(least({p['p']} - {p['n']}, {p['p2']} - {p['n2']}) + {need})"
    pairs = pairs.where(f"{den} * least({p['n']}, {p['n2']}) >= {num} * greatest({p['n']}, {p['n2']})")
    if heavy:
        pairs = pairs.where(f"{most} <= least(d, d2)")
    elif enough is None:
        pairs = pairs.where(f"{most} > least(d, d2)")
    m = most if enough is None else f"least({most}, greatest({FREE}L, least({p['m']}, {p['m2']})))"
    pairs = pairs.where(f"{p['at']} < {p['n']} - {need} + {m} and {p['at2']} < {p['n2']} - {need} + {m}")
    ask = F.expr(f"{m} - least(d, d2)" if enough is None else m)
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), ask.alias("m"))
    return pairs.groupBy("a", "b", "m").agg(F.count(F.lit(1)).alias("c")).where(enough or "c >= m").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, slim: DataFrame, k: int, num: int, den: int) -> DataFrame:
    sig = sets.select("id", "n", "sig").where("sig is not null")
    with_a = pairs.join(sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    with_b = with_a.join(sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    close = cut(with_b.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_verify_signature(num, den), "a long, b long"), "close")
    ids = cut(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct(), "ids")
    small = ids.count() <= SEND
    texts = cut(slim.join(F.broadcast(ids) if small else ids, "id", "left_semi"), "texts")
    both = close.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify_text(k, num, den), "a long, b long")
