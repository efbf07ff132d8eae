"""Every registered query of the engine against its SQL on the small tables."""

import os
from pathlib import Path

import pytest

from pagequery.plans import case_queries as q

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _rows(frame, columns):
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(q.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


TITLES = ["A &amp;&amp", "A&lt", "A &quot", "A&am", "A&", "&copy; B", "&copy B", "A &#65; &#x42", "A&amp;lt;", "A&amp;amp;&quot;", "&lt;A&gt; &amp;copy;", "&amp; &Eacute;&nbsp;&apos;&ampx;"]


@pytest.mark.parametrize("name", ["dsl_merge", "dsl_page_fields", "dsl_page_title"])
def test_references_as_the_sql_has_them(spark, duck, tmp_path, name):
    """Titles cut inside a reference, references that the SQL doesn't know, and those that come to light when others are read."""
    nav = '<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>'
    pages = [(i, "http://h.x/", f"<html><head><title>{t}</title></head><body>{nav}<h1>{h}</h1></body></html>") for i, (t, h) in enumerate(zip(TITLES, reversed(TITLES), strict=True))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duck.cursor()
    want = c.execute(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages.parquet/*.parquet') SELECT * FROM ({q.ORACLES[name]})").df()
    got = q.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(want) == len(pages) and _rows(got, list(want.columns)) == _rows(want, list(want.columns))
