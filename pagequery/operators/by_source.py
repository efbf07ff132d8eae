"""Steps in which every row brings the rules of its own source: one job over all sources, a failing one leaves an error in its rows only.

Plans are compiled in the workers, once a source and worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.java_regex import LIMIT, compile_java
from ..plans.rule_plan import compile_rule
from ..sources.requests import listing_requests, with_keys
from .kernel import Spec, evaluate_page, rule_field
from .steps import _COLUMNS, DETAIL_FIELDS, ITEM_FIELDS

_NAMES = [_COLUMNS[n] for n, _ in ITEM_FIELDS]
_ITEM = pa.struct([("pos", pa.int32()), *((n, pa.list_(pa.string()) if n == "kind" else pa.string()) for n in _NAMES)])
_OUT = pa.struct([("items", pa.list_(_ITEM)), ("_error", pa.string())])
_DDL = f"struct<items: array<struct<pos: int, {', '.join(f'{n}: ' + ('array<string>' if n == 'kind' else 'string') for n in _NAMES)}>>, _error: string>"


@lru_cache(maxsize=512)
def _specs(text: str) -> tuple[Spec, Spec | None, str, str]:
    """List spec, spec of a page that is a detail itself, pattern of such pages, and the list rule's sign."""
    rules = json.loads(text)
    search, explore, info = rules.get("ruleSearch") or {}, rules.get("ruleExplore") or {}, rules.get("ruleBookInfo") or {}
    use = explore if rules.get("step") == "explore" and (explore.get("bookList") or "").strip() else search
    rule = (use.get("bookList") or "").strip()
    sign = rule[:1] if rule[:1] in ("-", "+") else ""
    fields = tuple(rule_field(_COLUMNS[n], (use[n], kind), fails=n in ("name", "author", "bookUrl")) for n, kind in ITEM_FIELDS if use.get(n))
    lists = Spec((), compile_rule(rule[len(sign) :], listing=True), fields)
    one = tuple(rule_field(_COLUMNS[n], (info[n], kind)) for n, kind in DETAIL_FIELDS if info.get(n) and _COLUMNS[n] in _NAMES)
    init = (info.get("init") or "").strip()
    detail = (Spec((), compile_rule(init, listing=True), one) if init else Spec(one)) if one else None
    return lists, detail, rules.get("bookUrlPattern") or "", sign


def _detail_row(spec: Spec, body: str, url: str) -> list[dict[str, Any]]:
    out = evaluate_page(spec, body, url)
    row = (out["_items"][:1] or [{}])[0] if spec.items is not None else out
    return [{**{n: row.get(n) for n in _NAMES}, "pos": 0, "book_url": url}] if (row.get("name") or "").strip() else []


def _page(rules: str, body: str | None, url: str | None) -> dict[str, Any]:
    try:
        lists, detail, pattern, sign = _specs(rules)
        if pattern and detail and compile_java(pattern).fullmatch(url or "", timeout=LIMIT):
            return {"items": _detail_row(detail, body or "", url or ""), "_error": None}
        out = evaluate_page(lists, body, url)
        items = out.get("_items") or []
        if not items and not pattern and detail and out["_error"] is None:
            items = _detail_row(detail, body or "", url or "")
        kept: dict[str, dict] = {}
        for i in items:
            if (i.get("name") or "").strip():
                i["book_url"] = i.get("book_url") or url
                kept.setdefault(i["book_url"], i)
        rows = list(kept.values())
        rows = rows[::-1] if sign == "-" else rows
        return {"items": [{**{n: r.get(n) for n in _NAMES}, "pos": k} for k, r in enumerate(rows)], "_error": out["_error"]}
    except Exception as e:
        return {"items": [], "_error": f"pipeline_error: {type(e).__name__}: {e}"[:300]}


def _listing(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for rules, bodies, urls in batches:
        yield pa.array([_page(*x) for x in zip(rules.to_pylist(), bodies.to_pylist(), urls.to_pylist(), strict=True)], _OUT)


def search(sources: DataFrame, queries: DataFrame, responses: DataFrame, step: str = "search") -> DataFrame:
    """Rows found by every query (query_id, source_id, key, page) in its source, from recorded responses (key, body): listing columns, origin and order, or a row with ``_error`` and no name.

    With ``step`` ``explore`` queries have the ``url`` of a category, which makes the request; the search rules serve where the source has no rules for it."""
    rules = F.to_json(F.struct("ruleSearch", "ruleExplore", "ruleBookInfo", "bookUrlPattern", F.lit(step).alias("step")))
    origin = sources.where("_error is null and enabled").select(F.col("bookSourceUrl").alias("source_id"), F.col("bookSourceName").alias("origin_name"), F.col("customOrder").alias("origin_order"), rules.alias("rules"))
    if step == "explore" and "key" not in queries.columns:
        queries = queries.withColumn("key", F.lit(None).cast("string"))
    asked = listing_requests(sources, queries).join(origin, "source_id")
    keyed = with_keys(asked.withColumnRenamed("key", "query")).withColumn("_url_error", F.col("_error")).drop("_error")
    met = keyed.join(responses.select("key", F.col("body").alias("page_body")), "key", "left")
    got = met.withColumn("_p", F.arrow_udf(_listing, _DDL)("rules", "page_body", "url"))
    error = F.coalesce("_url_error", F.when(F.col("page_body").isNull(), F.lit("snapshot_miss")), F.col("_p._error"))
    rows = got.select("query_id", F.col("source_id").alias("origin"), "origin_name", "origin_order", error.alias("_error"), F.explode_outer(F.when(error.isNull(), F.col("_p.items"))).alias("_i"))
    return rows.select("query_id", "origin", "origin_name", "origin_order", "_i.*", "_error").where("name is not null or _error is not null")


def kinds_of(sources: DataFrame, memo: DataFrame | None = None, scripts=None) -> DataFrame:
    """Tiles of all sources' categories by ``memo_key`` (MD5 of the source and its rule); those that ``memo`` has are taken from it, so that a source is read again only when its rule changed."""
    from .steps import explore_kinds

    keyed = sources.select(F.col("bookSourceUrl").alias("source_id"), F.col("exploreUrl").alias("explore_url"), F.md5(F.concat("bookSourceUrl", F.coalesce("exploreUrl", F.lit("")))).alias("memo_key"))
    if memo is None:
        return explore_kinds(keyed, scripts=scripts)
    new = explore_kinds(keyed.join(memo.select("memo_key").distinct(), "memo_key", "left_anti"), scripts=scripts)
    return new.unionByName(memo.join(keyed.select("memo_key"), "memo_key", "left_semi"), allowMissingColumns=True)


def refresh_shelf(books: DataFrame, details: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books (book_url, …) after their details and contents were read again, and their entries. A detail that failed leaves the book as it was; contents that failed leave an ``_error`` in its row, and its old entries
    stay with whoever holds them: the second frame has entries of sound books only."""
    from .steps import summary

    sound = details.where("_error is null")
    fresh = [c for c in sound.columns if c in books.columns and c != "book_url"]
    new = sound.select("book_url", *[F.col(c).alias(f"_new_{c}") for c in fresh]).dropDuplicates(["book_url"])
    merged = books.join(new, "book_url", "left")
    merged = merged.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fresh else F.col(c) for c in books.columns])
    bad = entries.where("_error is not null").groupBy("book_url").agg(F.min("_error").alias("_error"))
    good = entries.where("_error is null").join(bad.select("book_url"), "book_url", "left_anti")
    return summary(merged, good).join(bad, "book_url", "left"), good
