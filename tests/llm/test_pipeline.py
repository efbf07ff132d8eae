"""The pipeline against a plain version of each stage, and the registered queries."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORDS, brute_components, prose


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    german = "der die das und nicht ein eine zu von mit für auf ist sich auch werden aber über schön größe".split()
    rows = [(i, prose(rng, rng.randint(20, 90), WORDS if i % 2 else german), "en" if i % 2 else "de") for i in range(120)]
    base = [f"alpha{i}" for i in range(80)]
    other = [*base[:40], "zzz", *base[41:]]
    rows += [(200, " ".join(base), "en"), (201, " ".join(base), "en"), (202, " ".join(other), "en"), (203, "12345 !!!", "en"), (204, None, "en"), (205, "leak one " + "q w e r t y u i o p a s d f g".upper(), "en"), (206, rows[3][1], None)]
    rows += [(207, prose(rng, 900) + " q w e r t y u i o p a s d f g " + prose(rng, 900), "en"), (208, "汉字汉字汉字汉字汉字 " * 20, None), (209, " ".join("".join(rng.choice("xqzkvjw") for _ in range(9)) for _ in range(40)), None)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "q w e r t y u i o p a s d f g")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline as cp

    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {i: t for i, t, _ in rows}
    columns, kept = docs.columns, dict(texts)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        ids = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            want = {i for i, t in kept.items() if t and any(c.isalpha() for c in t)} - {208, 209}
        elif name == "exact_dedup":
            want = {max(j for j, u in kept.items() if u == t) for i, t in kept.items()}
        elif name == "jaccard_join":
            want = {c for _, c in brute_components(list(kept.items())).values()}
        else:
            want = set(kept) - {205, 207}
        assert ids == want, name
        kept = {i: kept[i] for i in ids}
        out.write.mode("overwrite").parquet(f"{path}/stage.{name}")
        docs = spark.read.parquet(f"{path}/stage.{name}")
    got = cp.run(spark, path).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    from tokenizers import Tokenizer

    from pagequery.llm.tokens import default_path

    tok = Tokenizer.from_file(default_path())
    for r in got:
        ids = [*tok.encode(kept[r["doc_id"]], add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_stages_with_repeated_and_null_ids(spark, sf):
    import corpus_pipeline as cp

    path, rows = sf
    a, b, leak = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60)), "x q w e r t y u i o p a s d f g y"
    near_b = b.replace("beta30", "other")
    docs = [(5, a), (5, b), (9, a), (9, a), (None, near_b), (None, leak), (7, leak + " z"), (7, "short one"), (None, ""), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "_x": F.lit(1), "keep_id": F.lit(2), "n": F.lit(3), "spans": F.lit(4)})
    got = lambda df: sorted(map(str, ((r["doc_id"], r["text"]) for r in df.collect())))
    text = lambda out: sorted(str(x) for x in out)
    out = cp.exact(spark, frame, path)
    assert out.columns == frame.columns
    assert sorted(x.replace("None)", "'')") for x in got(out)) == text([(5, b), (9, a), (None, near_b), (None, leak), (7, leak + " z"), (7, "short one"), (None, "")])
    assert got(cp.near(spark, frame, path)) == text([(5, b), (5, a), (7, leak + " z"), (7, "short one"), (None, ""), (None, None)])
    assert got(cp.leaks(spark, frame, path)) == text([d for d in docs if "q w e" not in (d[1] or "")])


def test_stages_of_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline as cp

    path, _ = sf
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0, name
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert cp.leaks(spark, docs, str(tmp_path)).count() == docs.count()


def test_queries_are_registered(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op5_suffix_dedup", "op7_exact_dedup", "op8_decontaminate", "op9_warc", "op10_jaccard"])
def test_query_against_sql(spark, name):
    import os

    import duckdb

    import __spark_entry__ as e

    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.execute(e.oracle_sql()[name]).fetchall()
    cols = [x[0] for x in c.description]
    got = [tuple(r[x] for x in cols) for r in e.queries()[name](spark, d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
