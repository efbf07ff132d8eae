"""Tables of books, chapters, caches, highlights, sources and cookies: the relational operations on them, as pure functions of DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(table: DataFrame, rows: DataFrame, key: list[str], unique: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows replace those with their key; with ``unique`` also rows of another key that have the same values there. Of repeated new rows the last in ``order`` counts; without an order the greatest by all
    columns, so that a key is never there twice."""
    by = [F.col(order).desc()] if order is not None else [F.col(c).desc_nulls_last() for c in rows.columns if dict(rows.dtypes)[c].split("<")[0] != "map"]
    for names in (key, unique):
        if names:
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(*by))).where("_r = 1").drop("_r")
    kept = table.join(rows.select(*key), key, "left_anti")
    if unique:
        kept = kept.join(rows.select(*unique).distinct(), unique, "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def replace_children(children: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The parents' children are the new rows."""
    return children.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows that belong to the deleted keys (one column)."""
    (name,) = gone.columns
    return {t: df.join(gone.select(F.col(name).alias(keys[t])).distinct(), keys[t], "left_anti") for t, df in tables.items()}


def update(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Columns of ``changes`` overwrite those of rows with the same key."""
    names = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def prefix_scan(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose value starts with the prefix, literally; the filter reaches the scan."""
    return table.where(F.col(column).startswith(prefix))


def lookup(table: DataFrame, **key) -> DataFrame:
    """The row with a key; the filter reaches the scan."""
    for name, value in key.items():
        table = table.where(F.col(name) == value)
    return table


def children(table: DataFrame, parent: str, value, order: str = "index") -> DataFrame:
    """Rows of a parent in order."""
    return table.where(F.col(parent) == value).orderBy(order)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("customOrder", "bookSourceUrl")


def count(table: DataFrame) -> DataFrame:
    """One row with the number of rows ``n``; from the files' footers where there is no filter."""
    return table.agg(F.count(F.lit(1)).alias("n"))


# Columns of the tables and the keys of their rows.
TABLES = {
    "books": ("bookUrl string, tocUrl string, origin string, originName string, name string, author string, kind string, coverUrl string, intro string, latestChapterTitle string, totalChapterNum int, durChapterTitle string, durChapterIndex int, durChapterPos int, durChapterTime bigint, wordCount string, `order` int, variable string", ["bookUrl"]),
    "chapters": ("url string, title string, isVolume boolean, baseUrl string, bookUrl string, index int, isVip boolean, isPay boolean, tag string, wordCount string, variable string", ["url", "bookUrl"]),
    "caches": ("key string, value string, deadline bigint", ["key"]),
    "highlights": ("id string, book_url string, chapter_url string, chapter_index int, chapter_pos int, chapter_pos_end int, text string, time bigint", ["id"]),
    "book_sources": ("bookSourceUrl string, bookSourceName string, customOrder int, enabled boolean, json string", ["bookSourceUrl"]),
    "cookies": ("url string, cookie string", ["url"]),
}


def create(spark, name: str) -> DataFrame:
    """An empty table of the store."""
    return spark.createDataFrame([], TABLES[name][0])


def migrate(table: DataFrame, schema: str, renamed: dict[str, str] | None = None, defaults: dict | None = None) -> DataFrame:
    """A table in a newer schema (DDL): columns cast, some under new names, missing ones with their default or null, others gone."""
    old_name = {new: old for old, new in (renamed or {}).items()}
    kinds = table.sparkSession.createDataFrame([], schema).schema
    out = []
    for f in kinds:
        source = old_name.get(f.name, f.name)
        value = F.col(f"`{source}`") if source in table.columns else F.lit((defaults or {}).get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return table.select(*out)


def live(table: DataFrame, now: int, deadline: str = "deadline") -> DataFrame:
    """Rows without a deadline or before it."""
    return table.where((F.col(deadline) == 0) | (F.col(deadline) > now))


def apply_delta(table: DataFrame, upserts: DataFrame, deletes: DataFrame, key: list[str]) -> DataFrame:
    return upsert(table.join(deletes.select(*key), key, "left_anti"), upserts, key)


def shelf_order(books: DataFrame) -> DataFrame:
    return books.orderBy(F.col("order").asc(), F.col("durChapterTime").desc())


def highlights(table: DataFrame, book: str, chapter: str | None = None) -> DataFrame:
    """Annotations of a book or chapter in order of their intervals."""
    rows = table.where(F.col("book_url") == book)
    if chapter is not None:
        return rows.where(F.col("chapter_url") == chapter).orderBy("chapter_pos", "chapter_pos_end", "time")
    return rows.orderBy("chapter_index", "chapter_pos", "chapter_pos_end", "time")


def exists(table: DataFrame, condition: Column) -> bool:
    return not table.where(condition).limit(1).isEmpty()


def cached_flags(chapters: DataFrame, caches: DataFrame, url: str = "url", key: str = "key", prefix: str = "content:") -> DataFrame:
    """Chapters with ``cached``: whether their content is in the cache."""
    have = caches.where(F.col(key).startswith(prefix)).select(F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key)).alias(url)).distinct()
    return chapters.join(have.withColumn("cached", F.lit(True)), url, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def read_through(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the cache has of the wanted keys, and the keys that must be computed."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


# --- cookies


def parse_cookie(text: str | None) -> dict[str, str]:
    """Pairs of a cookie header; parts without a name or a value are left out, except a value ``null``."""
    out: dict[str, str] = {}
    for part in (text or "").split(";"):
        name, eq, value = part.partition("=")
        if eq and name.strip() and (value.strip() or value.strip() == "null"):
            out[name.strip()] = value.strip()
    return out


def merge_cookies(*texts: str | None, limit: int = 4096) -> str:
    """Cookies of several headers, later ones over earlier ones; while the whole is too long a pair is dropped."""
    pairs: dict[str, str] = {}
    for t in texts:
        pairs.update(parse_cookie(t))
    while len(out := "; ".join(f"{k}={v}" for k, v in pairs.items())) > limit and pairs:
        pairs.pop(next(reversed(pairs)))
    return out


def set_cookies(headers: list[str], now: float | None = None) -> list[tuple[str, str, bool]]:
    """Name, value and persistence of Set-Cookie headers; one that is out of date comes with an empty value."""
    import time
    from email.utils import parsedate_to_datetime

    now = time.time() if now is None else now
    out = []
    for h in headers:
        pair, *attributes = h.split(";")
        name, eq, value = pair.partition("=")
        if not eq or not name.strip():
            continue
        end = None
        for a in attributes:
            k, _, v = a.partition("=")
            k, v = k.strip().lower(), v.strip()
            if k == "max-age" and v.lstrip("-").isdigit():
                end = now + int(v)
            elif k == "expires" and end is None:
                try:
                    end = parsedate_to_datetime(v).timestamp()
                except (ValueError, TypeError):
                    end = None
        gone = end is not None and end <= now
        out.append((name.strip(), "" if gone else value.strip().strip('"'), end is not None))
    return out


def cookie_header(stored: str | None, session: str | None = None, request: str | None = None) -> str:
    """What a request sends: the stored cookies, those of the session over them, its own over both."""
    return merge_cookies(stored, session, request)


def save_cookies(stored: str | None, session: str | None, headers: list[str], now: float | None = None) -> tuple[str, str]:
    """Stored and session cookies after a response: persistent ones are kept with the stored, others with the session's, expired ones go from both."""
    found = set_cookies(headers, now)
    lasting, passing = parse_cookie(stored), parse_cookie(session)
    for name, value, persistent in found:
        for pairs in (lasting, passing):
            pairs.pop(name, None)
        if value:
            (lasting if persistent else passing)[name] = value
    join = lambda pairs: merge_cookies("; ".join(f"{k}={v}" for k, v in pairs.items()))
    return join(lasting), join(passing)


def cookie_of(text: str | None, name: str) -> str:
    return parse_cookie(text).get(name, "")


def without_cookies(table: DataFrame, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Cookies of all but the given domains (one column)."""
    return table.join(domains.toDF(domain).distinct(), domain, "left_anti")


def merged_cookies(rows: DataFrame, domain: str = "domain", cookie: str = "cookie", order: str = "seq") -> DataFrame:
    """One header per domain out of its cookies in order."""
    @F.arrow_udf("string")
    def folded(lists: pa.Array) -> pa.Array:
        return pa.array([merge_cookies(*texts) for texts in lists.to_pylist()], pa.string())

    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cookie).alias("c")))), lambda x: x["c"])
    return rows.groupBy(domain).agg(parts.alias("_parts")).select(domain, folded("_parts").alias(cookie))
