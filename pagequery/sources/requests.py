"""Requests as data: URL rules with pages, templates and options become request rows, which meet recorded responses by key."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_function
from ..functions.url import absolute, encode_form, encode_query, js_escape, page_list, split_option
from ..operators.evaluate import Context, Evaluator
from ..operators.jsonpath import lenient
from ..plans.scripts import ScriptRegistry
from .folder import hold


class UrlError(ValueError):
    """A URL rule that can't be made a request."""


@dataclass
class Request:
    url: str
    method: str = "GET"
    headers: list[tuple[str, str]] = field(default_factory=list)
    body: str | None = None
    charset: str | None = None
    type: str | None = None
    retry: int = 0
    options: dict[str, Any] = field(default_factory=dict)


def build_request(rule: str, base_url: str = "", key: str | None = None, page: int | None = None, headers: dict[str, str] | None = None, scripts: ScriptRegistry | None = None) -> Request:
    """The request of a URL rule: templates filled, the page chosen, the rest after the comma read as options, the URL made absolute and its query encoded."""
    context = Context(base_url=base_url, redirect_url=base_url, bindings={"key": key, "page": page, "baseUrl": base_url}, scripts=scripts or ScriptRegistry())
    e = Evaluator("", context)

    def fill(m: re.Match) -> str:
        body = m[1]
        if body.startswith(("@", "$.", "$[", "//")):
            return e.string(body)
        v = context.scripts.find(body)(None, context)
        return "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    text = re.sub(r"\{\{([\w\W]*?)\}\}", fill, rule)
    try:
        text = page_list(text, page)
    except ValueError as error:
        raise UrlError(str(error)) from None
    url, option = split_option(text)
    request = Request(absolute(base_url, url), headers=list((headers or {}).items()))
    if option is not None:
        try:
            options = lenient(option)
        except ValueError:
            options = None
        if isinstance(options, dict):
            _apply(request, options)
    head, mark, query = request.url.partition("?")
    charset = request.charset or "utf-8"
    if charset == "escape":
        enc = js_escape
    else:
        enc = lambda q: encode_query(q, charset)
    if request.method == "POST":
        kind = next((v for k, v in request.headers if k.lower() == "content-type"), "")
        if request.body and not kind and not request.body.strip().startswith(("{", "[", "<")):
            request.body = encode_form(request.body, charset if charset != "escape" else "utf-8")
    elif mark:
        request.url = head + "?" + enc(query)
    return request


def _apply(r: Request, o: dict[str, Any]) -> None:
    r.method = "POST" if str(o.get("method", "")).upper() == "POST" else "HEAD" if str(o.get("method", "")).upper() == "HEAD" else "GET"
    headers = o.get("headers")
    if isinstance(headers, str):
        try:
            headers = lenient(headers)
        except ValueError:
            headers = None
    if isinstance(headers, dict):
        r.headers += [(str(k), str(v)) for k, v in headers.items()]
    body = o.get("body")
    if body is not None:
        import json

        r.body = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    r.charset, r.type = o.get("charset"), o.get("type")
    retry = o.get("retry")
    r.retry = int(retry) if isinstance(retry, (int, float)) or isinstance(retry, str) and retry.isdigit() else 0
    r.options = {k: v for k, v in o.items() if k not in ("method", "headers", "body", "charset", "type", "retry")}


def request_key(method: str, url: str, body: str | None) -> str:
    """Key of a recorded response: the first 16 bytes of a SHA-256 in hex."""
    return hashlib.sha256("\n".join([method, url, body or ""]).encode()).hexdigest()[:32]


def with_keys(requests: DataFrame) -> DataFrame:
    """The same key as a native column of requests (method, url, body)."""
    text = F.concat_ws("\n", "method", "url", F.coalesce("body", F.lit("")))
    return requests.withColumn("key", F.substring(F.sha2(text, 256), 1, 32))


def fetch(requests: DataFrame, responses: DataFrame, hops: int = 20) -> DataFrame:
    """Recorded responses of requests, redirects followed. ``_error``: ``snapshot_miss`` or ``too_many_redirects``.

    A location is resolved against the address that gave it. 300 to 303 go on as GET without a body unless the request was GET or HEAD; 307 and 308 are followed for GET and HEAD only, and
    keep the method; one that leads to another scheme than http and https is a final answer. With a column ``follow_redirects`` that is false the first answer counts. Addresses
    ``data:…;base64,…`` answer with their own bytes as text.
    """
    rows = with_keys(requests).withColumns({"final_url": F.col("url"), "hops": F.lit(0)})
    if "follow_redirects" not in rows.columns:
        rows = rows.withColumn("follow_redirects", F.lit(True))
    slim = responses.select("key", "status", "location", F.col("body").alias("response_body"))
    own = F.col("url").rlike("(?i)^data:[^,]*;base64,")
    inline = rows.where(own).withColumns({"status": F.lit(200), "location": F.lit(None).cast("string"), "response_body": F.decode(F.unbase64(F.regexp_extract("url", "^[^,]*,(.*)$", 1)), "UTF-8"), "_error": F.lit(None).cast("string")})
    rows = hold(rows.where(~own), "requests")
    done = [inline]
    bare = F.col("method").isin("GET", "HEAD")
    for _ in range(hops + 1):
        met = rows.join(slim, "key", "left")
        redirect = F.coalesce(F.col("follow_redirects"), F.lit(True)) & F.col("location").isNotNull() & (F.col("status").between(300, 303) | F.col("status").isin(307, 308) & bare)
        met = hold(met.withColumn("_next", F.when(redirect, column_function(absolute)("final_url", "location"))), "answers")
        going = F.coalesce(F.col("_next").rlike("(?i)^https?://"), F.lit(False))
        done.append(met.where(~going).withColumn("_error", F.when(F.col("status").isNull(), F.lit("snapshot_miss"))).drop("_next"))
        further = met.where(going)
        further = further.withColumns({"url": F.col("_next"), "final_url": F.col("_next"), "hops": F.col("hops") + 1, "method": F.when(bare, F.col("method")).otherwise("GET"), "body": F.when(bare, F.col("body"))})
        rows = hold(with_keys(further.drop("key", "status", "location", "response_body", "_next")), "requests")
        if rows.isEmpty():
            break
    else:
        done.append(rows.join(slim, "key", "left").withColumn("_error", F.lit("too_many_redirects")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out if "follow_redirects" in requests.columns else out.drop("follow_redirects")


def response_text(body: Column, kind: Column, content_type: Column | None = None) -> Column:
    """What rules read of a response: hexadecimal digits of its bytes where the request asks for a type; text else, XML without a prolog with one."""
    text = F.decode(body, "UTF-8")
    head = F.ltrim(text)
    xml = F.coalesce(content_type.rlike("(?i)xml"), F.lit(False)) if content_type is not None else F.lit(False)
    with_prolog = F.when(xml & head.startswith("<") & ~head.rlike("(?i)^(<\\?xml|<!doctype|<html)"), F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>'), text)).otherwise(text)
    return F.when(F.coalesce(kind, F.lit("")) != "", F.lower(F.hex(body))).otherwise(with_prolog)


_REQUEST = pa.struct([("url", pa.string()), ("method", pa.string()), ("body", pa.string()), ("_error", pa.string())])


def _request_rows(rules: pa.Array, bases: pa.Array, keys: pa.Array, pages: pa.Array) -> pa.Array:
    rows = []
    for rule, base, key, page in zip(*(x.to_pylist() for x in (rules, bases, keys, pages)), strict=True):
        try:
            r = build_request(rule or "", base or "", key, page)
            rows.append({"url": r.url, "method": r.method, "body": r.body, "_error": None})
        except ValueError as e:
            rows.append({"url": None, "method": None, "body": None, "_error": f"url_error: {e}"})
    return pa.array(rows, _REQUEST)


def listing_requests(sources: DataFrame, queries: DataFrame, rule: str = "searchUrl") -> DataFrame:
    """Requests of every query of its source: (query_id, source_id, key, page), by the source's ``rule``; or, where queries have a ``url`` of a category, by that. The source table is small and bounded."""
    s = sources.select(F.col("bookSourceUrl").alias("source_id"), F.col(rule).alias("_rule"))
    joined = queries.join(s, "source_id")
    use = F.coalesce("url", "_rule") if "url" in queries.columns else F.col("_rule")
    kept = [c for c in queries.columns if c != "url"]
    return joined.select(*kept, F.inline_outer(F.array(F.arrow_udf(_request_rows, "struct<url: string, method: string, body: string, _error: string>")(use, "source_id", "key", "page"))))


#: Sent where a source names no agent of its own.
USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"


def source_headers(header: str | None, agent: str = USER_AGENT, scripts: ScriptRegistry | None = None) -> dict[str, str]:
    """Headers of a source: JSON, or a script that gives JSON; an agent is added if there is none. What can't be read gives the agent alone."""
    text = (header or "").strip()
    m = re.match(r"(?is)<js>(.*?)</js>|@js:(.*)", text)
    if m:
        value = (scripts or ScriptRegistry()).find(m[1] if m[1] is not None else m[2])(None, Context())
        text = "" if value is None else str(value)
    out: dict[str, str] = {}
    if text:
        try:
            value = lenient(text)
            out = {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else {}
        except ValueError:
            out = {}
    if not any(k.lower() == "user-agent" for k in out):
        out["User-Agent"] = agent
    return out
