"""Registered queries over small literal tables, a case a row: every selector, step, axis, path, helper and store operation meets its expected value in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import java_regex, render, scalars, url
from ..functions.columns import column_function
from ..operators import by_source, document, steps
from ..operators.frontier import join_pages
from ..operators.kernel import TEXTS, URL, URLS, Css, extract, extract_list
from ..sources import charset, requests, store
from ..sources.records import read_sources, unpivot_rules
from . import native
from .queries import ORACLES, QUERIES

PAGE = """<html><head><title>Shop  list</title><script>var a = 1;</script></head><body>
<div id="top" class="Box main" data-k="v1">Intro<p class="first">One <b>bold</b> text</p><p>Two</p><p lang="en-GB">Three</p></div>
<ul id="list"><li class="a">A1</li><li class="b">B1</li><li class="a c">A2</li><li></li></ul>
<a href="/x/1.html?k=1">go</a><a href="http://other.org/y.PDF">pdf</a><img src="i.png"><span> spaced </span>
</body></html>"""
JSON = '{"a":{"b":[1,2.5,"x",null,true]},"c":[{"k":1,"v":"p"},{"k":5,"v":"q"},{"k":9,"v":"r"}],"d e":"z","n":1e3,"s":"5"}'


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, expected: dict[str, str | None]):
    """Registers a query that returns (case, value), with what SQL should give."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark)
        rows = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in expected.items())
        ORACLES[name] = f'SELECT "case", value FROM (VALUES {rows}) t("case", value)'
        return f

    return add


def _long(df: DataFrame, names) -> DataFrame:
    """One row per column of a one-row frame."""
    pairs = [F.struct(F.lit(n).alias("case"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]
    return df.select(F.inline(F.array(*pairs)))


def _page(spark, content: str = PAGE, base: str = "http://h.org/a/b") -> DataFrame:
    return spark.createDataFrame([(content, base)], "html string, url string")


# --- selectors: number of elements and what they give

_CSS = {
    "tag, child #id .class": ("#top > p.first", "text", "1:One bold text"), ".class": (".a", "text", "2:A1|A2"), "*": ("ul > *", "text", "4:A1|B1|A2|"), "*|tag": ("*|b", "text", "1:bold"),
    "[a]": ("[data-k]", "attr:id", "1:top"), "[^prefix]": ("[^data-]", "attr:id", "1:top"), "[a=v]": ("[lang=en-gb]", "text", "1:Three"), "[a!=v]": ("p[lang!=en-GB]", "text", "2:One bold text|Two"),
    "[a^=v]": ("a[href^=/x]", "text", "1:go"), "[a$=v]": ("a[href$=.pdf]", "text", "1:pdf"), "[a*=v]": ("a[href*=other]", "text", "1:pdf"), "[a~=re]": (r"a[href~=\d+\.html]", "text", "1:go"),
    ":lt": ("li:lt(1)", "text", "1:A1"), ":gt": ("li:gt(1)", "text", "2:A2|"), ":eq": ("li:eq(1)", "text", "1:B1"), ":first-child": ("li:first-child", "text", "1:A1"), ":last-child": ("li:last-child", "text", "1:"),
    ":only-child": ("b:only-child", "text", "1:bold"), ":nth-child(2n+1)": ("li:nth-child(2n+1)", "text", "2:A1|A2"), ":nth-child(even)": ("li:nth-child(even)", "text", "2:B1|"), ":nth-of-type": ("p:nth-of-type(2)", "text", "1:Two"),
    ":nth-last-of-type": ("p:nth-last-of-type(1)", "text", "1:Three"), ":first-of-type": ("p:first-of-type", "text", "1:One bold text"), ":last-of-type": ("p:last-of-type", "text", "1:Three"), ":empty": ("li:empty", "text", "1:"),
    ":root": (":root > head > title", "text", "1:Shop list"), ":contains": ("p:contains(BOLD)", "text", "1:One bold text"), ":containsOwn": ("div:containsOwn(intro)", "attr:id", "1:top"), ":matches": (r"li:matches(^A\d$)", "text", "2:A1|A2"),
    ":matchesOwn": ("p:matchesOwn(^T)", "text", "2:Two|Three"), ":has": ("div:has(b)", "attr:id", "1:top"), ":not": ("li:not(.a)", "text", "2:B1|"), "descendant": ("div b", "text", "1:bold"), "+": ("li.a + li", "text", "2:B1|"),
    "~": ("li.b ~ li", "text", "2:A2|"), ",": ("b, span", "text", "2:bold|spaced"), "leading >": ("> html > head > title", "text", "1:Shop list"), "data": ("script", "data", "1:var a = 1;"), "wholeText": ("span", "wholeText", "1: spaced "),
    "ownText": ("p.first", "ownText", "1:One text"), "html": ("p.first", "html", "1:One <b>bold</b> text"), "outerHtml": ("p.first", "outerHtml", '1:<p class="first">One <b>bold</b> text</p>'),
}


@cases("cases_css", {k: v[2] for k, v in _CSS.items()})
def _css(spark):
    out = extract(_page(spark), {k: Css(s, a) for k, (s, a, _) in _CSS.items()})
    return _long(out.select(*[F.concat(F.size(f"`{k}`").cast("string"), F.lit(":"), F.array_join(f"`{k}`", "|")).alias(k) for k in _CSS]), _CSS)


# --- rules

_RULES = {
    "children": ("id.list@children@text", "A1\nB1\nA2"), "children.i": ("children.0@tag.title@text", "Shop list"), "class": ("class.first@text", "One bold text"), "index -1:0": ("tag.li.-1:0@text", "A1"), "id": ("id.top@tag.p.0@text", "One bold text"),
    "text.x": ("text.Two@text", "Two"), "css step": ("ul > li.b@text", "B1"), "exclude !": ("tag.li!0:1@text", "A2"), "list []": ("tag.li[0,2]@text", "A1\nA2"), "slice back": ("tag.li[-2:0]@text", "A2\nB1\nA1"), "exclude [!]": ("tag.li[!1]@text", "A1\nA2"),
    "textNodes": ("id.top@textNodes", "Intro"), "ownText": ("class.first@ownText", "One text"), "html": ("class.first@html", '<p class="first">One <b>bold</b> text</p>'), "all": ("class.first@all", '<p class="first">One <b>bold</b> text</p>'), "attr": ("id.top@data-k", "v1"),
    "@CSS: alone": ("@CSS:", "var a = 1;"), "@css:": ("@css:li.a@text", "A1\nA2"), "##re##to": (r"tag.title@text##\s+##_", "Shop_list"), "##re##to###": (r"tag.title@text##(\w+)\s.*##<$1>###", "<Shop>"), "||": ("class.none@text||tag.b@text", "bold"),
    "&&": ("tag.b@text&&tag.span@text", "bold\nspaced"), "%%": ("class.a@text%%class.b@text", "A1\nB1\nA2"), "trimmed": (" tag.b@text", "bold"), "@@": ("@@tag.b@text", "bold"), "{{rule}}": ("<{{@@tag.b@text}}|{{@css:span@text}}>", "<bold|spaced>"),
    "@put": ('@put:{"t":"tag.b@text"}tag.span@text', "spaced"), "@get": ("v=@get:{t}", "v=bold"), "{{page}}": ("p{{page}}-{{page+1}}-{{(page-1)*20}}", "p3-4-40"), "key": ("{{key}}", "k"), "bad regex": ("tag.b@text##[##x", "bold"), "literal": ("tag.b@text##bo##[$]", "[$]ld"),
}


@cases("cases_rules", {k: v[1] for k, v in _RULES.items()})
def _rules(spark):
    return _long(extract(_page(spark), {k: r for k, (r, _) in _RULES.items()}, bindings={"page": 3, "key": "k"}), _RULES)


_XPATH = {
    "index": ("@XPath://li[2]/text()", "B1"), "or": ("//li[@class='a' or @class='b']/text()", "A1\nB1"), "and, contains": ("//p[@lang='en-GB' and contains(text(),'Th')]/text()", "Three"), "count": ("@XPath:count(//li)", "4"), "+ * - div": ("@XPath:1+2*3-4 div 2", "5.0"),
    "mod": ("@XPath:7 mod 4", "3.0"), "position": ("//li[position()<3]/text()", "A1\nB1"), "parent": ("//b/parent::p/@class", "first"), "ancestor": ("//b/ancestor::div/@id", "top"), "following-sibling": ("//li[1]/following-sibling::li/text()", "B1\nA2"),
    "child": ("//ul/child::li[2]/text()", "B1"), "|": ("//title/text()|//b/text()", "Shop list\nbold"), "starts-with": ("//a[starts-with(@href,'/x')]/text()", "go"), ".=": ("//p[.='Two']/text()", "Two"), "^=": ("//a[@href^='http']/text()", "pdf"),
    "$=": ("//a[@href$='k=1']/text()", "go"), "*=": ("//a[@href*='other']/text()", "pdf"), "~=": ("//a[@href~='.*html.*']/text()", "go"), "concat": ("@XPath:concat('a','-',//b/text())", "a-bold"), "string-length": ("@XPath:string-length('abcd')", "4"),
    "substring": ("@XPath:substring('abcdef',2,3)", "bcd"), "not": ("@XPath:not(1=2)", "true"), "//": ("//div//b/text()", "bold"), "..": ("//b/../@class", "first"), "* and @": ("//*[@id='top']/@data-k", "v1"), "allText": ("//span/allText()", "spaced"),
    "html": ("//p[1]/html()", "One <b>bold</b> text"), "outerHtml": ("//p[1]/outerHtml()", '<p class="first">One <b>bold</b> text</p>'), "unary -": ("@XPath:-3+1", "-2.0"), ">": ("@XPath:3>2", "true"), "<=": ("@XPath:3<=2", "false"), "attributes": ("//li[@class]/@class", "a\nb\na c"),
    "!=": ("@XPath:'a'!='b'", "true"),
}


@cases("cases_xpath", {**{k: v[1] for k, v in _XPATH.items()}, "fragment": "x"})
def _xpath(spark):
    out = extract(_page(spark), {k: r for k, (r, _) in _XPATH.items()})
    cell = extract(_page(spark, "<td>x</td>"), {"fragment": "@XPath://tr/td/text()"})
    return _long(out, _XPATH).unionByName(_long(cell, ["fragment"]))


_PATHS = {
    "[i]": ("$.a.b[0]", "1"), "double": ("$.a.b[1]", "2.5"), "[-i]": ("$.a.b[-1]", "true"), "[i,j]": ("$.a.b[0,2]", "1\nx"), "[*]": ("$.c[*].v", "p\nq\nr"), "[a:]": ("$.c[1:].v", "q\nr"), "[:b]": ("$.c[:1].v", "p"), "[a:b]": ("$.c[0:2].k", "1\n5"), "..": ("$..k", "1\n5\n9"),
    ">=": ("$.c[?(@.k>=5)].v", "q\nr"), "<=": ("$.c[?(@.k<=5)].v", "p\nq"), "==": ("$.c[?(@.v=='p')].k", "1"), "!=": ("$.c[?(@.k!=5)].v", "p\nr"), "&&": ("$.c[?(@.k<9 && @.k>1)].v", "q"), "||": ("$.c[?(@.k==1 || @.v=='r')].v", "p\nr"), "exists": ("$.c[?(@.x)].v", ""),
    "!()": ("$.c[?(!(@.k==1))].v", "q\nr"), "['k']": ("$['d e']", "z"), "['a','b']": ("$.c[0]['k','v']", "{k=1, v=p}"), "['a','b'] of many": ("$.c[*]['k','v']", "{k=1, v=p}\n{k=5, v=q}\n{k=9, v=r}"), "exponent": ("$.n", "1000.0"), "object": ("$.a", "{b=[1, 2.5, x, null, true]}"),
    "list": ("$.a.b", "1\n2.5\nx\nnull\ntrue"), "missing": ("$.missing", ""), "@Json:": ("@Json:$.s", "5"), "and": ("$.s&&$.n", "5\n1000.0"), "or": ("$.missing||$.s", "5"), "{{$.}}": ("{{$.s}}-{{$.n}}", "5-1000.0"), "{$.}": ("a{$.s}b", "a5b"),
}


@cases("cases_jsonpath", {**{k: v[1] for k, v in _PATHS.items()}, "lenient": "v", "items": "p,q,r"})
def _jsonpath(spark):
    out = _long(extract(_page(spark, JSON), {k: r for k, (r, _) in _PATHS.items()}), _PATHS)
    loose = _long(extract(_page(spark, "{a: 'v', /* c */ 'b': [1,],}"), {"lenient": "$.a"}), ["lenient"])
    rows = extract_list(_page(spark, JSON), "$.c[*]", {"v": "$.v"}).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), ",").alias("items"))
    return out.unionByName(loose).unionByName(_long(rows, ["items"]))


# --- lists, regular expressions, merges

@cases("cases_lists", {"regex chain": "1=x;2=y", "elements": "A1;B1;A2;", "merge &&": "1,2,3", "merge ||": "3", "merge %%": "1,3,2", "list &&": "a1,b1", "urls": "http://h.org/x/1.html?k=1,http://other.org/y.PDF", "url": "http://h.org/a/i.png", "find_all": "ab|a|b;cd|c|d", "variable": "two", "no error": None, "field error": "bad: SelectorError"})
def _lists(spark):
    joined = lambda df, col: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(col).alias("v")))), lambda x: x["v"]), ";").alias("v"))
    rows = joined(extract_list(_page(spark, "<i>k1=x</i><b>k3=z</b><i>k2=y</i>"), ":<i>.*?</i>&&k(\\d)=(\\w)", {"v": "$1=$2"}), "v").select(F.lit("regex chain").alias("case"), F.col("v").alias("value"))
    rows = rows.unionByName(joined(extract_list(_page(spark), "id.list@tag.li", {"v": "text"}), "v").select(F.lit("elements").alias("case"), F.col("v").alias("value")))
    a, b = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"))
    one = extract(_page(spark), {"list": ("class.a.0@text&&class.b@text", TEXTS), "urls": ("tag.a@href", URLS), "url": ("tag.img@src", URL), "bad": ("@CSS:li:zz@text", TEXTS)}, report="errors")
    groups = native.regex_rows(F.lit("ab cd"), r"(\w)(\w)", 2)
    layers = (F.create_map(F.lit("a"), F.lit("")), F.create_map(F.lit("a"), F.lit("two")))
    one = one.select(
        F.array_join(native.merge_and(a, b), ",").alias("merge &&"), F.array_join(native.merge_or(F.array().cast("array<string>"), b), ",").alias("merge ||"), F.array_join(native.merge_zip(a, b), ",").alias("merge %%"),
        F.lower(F.array_join("list", ",")).alias("list &&"), F.array_join("urls", ",").alias("urls"), "url", F.array_join(F.transform(groups, lambda g: F.concat_ws("|", g["g0"], g["g1"], g["g2"])), ";").alias("find_all"),
        native.variable("a", *layers).alias("variable"), F.col("_error").alias("no error"), F.regexp_extract(F.element_at("errors", 1), "^[^:]*: [^:]*", 0).alias("field error"),
    )
    return rows.unionByName(_long(one, one.columns))


_REGEX = {
    "replace": ("aXbX", "X", "-", "a-b-"), "groups": ("k=v", r"(\w)=(\w)", "$2=$1", "v=k"), "first": ("aXbX", "X(.)", "<$1>", "a<b>X"), "class": ("a1 b2", r"[\p{L}&&[^b]]", "_", "_1 b2"), "possessive": ("aaa", "a++", "x", "x"), "look-behind": ("ab cb", "(?<=a)b", "X", "aX cb"), "named": ("2024-05", r"(?<y>\d+)-(?<m>\d+)", "${m}/${y}", "05/2024"),
    "quote": ("a.b", r"\Q.\E", "!", "a!b"), "escape": ("a$b", r"\$", r"\$\$", "a$$b"), "case": ("aBc", "(?i)b", "-", "a-c"), "dot all": ("a\nb", "(?s)a.b", "x", "x"), "ascii space": ("a　b", r"\s", "_", "a　b"), "broken": ("a[b", "[", "(", "a(b"),
}


@cases("cases_regex", {k: v[3] for k, v in _REGEX.items()} | {"full match": "true", "no full match": "false"})
def _regex(spark):
    rows = spark.createDataFrame([(k, t, p, r) for k, (t, p, r, _) in _REGEX.items() if k != "first"], "`case` string, a string, b string, c string")
    out = rows.select("case", column_function(lambda t, p, r: java_regex.replace(t, p, r, False))("a", "b", "c").alias("value"))
    t, p, r, _ = _REGEX["first"]
    first = spark.createDataFrame([("first", t, p, r)], "`case` string, a string, b string, c string").select("case", column_function(lambda t, p, r: t[:1] + java_regex.replace(t, p, r, True) + t[3:])("a", "b", "c").alias("value"))
    full = spark.createDataFrame([("full match", "http://h/1", r"http://h/\d"), ("no full match", "http://h/1x", r"http://h/\d")], "`case` string, a string, b string")
    return out.unionByName(first).unionByName(full.select("case", column_function(url.matches, "boolean")("a", "b").cast("string").alias("value")))


# --- addresses

_URLS = {
    "relative": (url.absolute, ("http://h.org/a/b", "c?d=1"), "http://h.org/a/c?d=1"), "root": (url.absolute, ("http://h.org/a/b", "/c"), "http://h.org/c"), "dots": (url.absolute, ("http://h.org/a/b/c", "../d/./e"), "http://h.org/a/d/e"), "scheme": (url.absolute, ("https://h.org/a", "//x.y/z"), "https://x.y/z"),
    "absolute": (url.absolute, ("http://h.org", " http://x/y "), "http://x/y"), "script": (url.absolute, ("http://h.org", "javascript:f()"), ""), "data": (url.absolute, ("http://h.org", "data:a;base64,AA"), "data:a;base64,AA"), "option cut": (url.absolute, ("http://h.org/a,{x}", "b"), "http://h.org/b"), "query only": (url.absolute, ("http://h.org/a/b?x", "?y"), "http://h.org/a/?y"),
    "base": (url.base_url, ("http://h.org:80/a",), "http://h.org:80"), "domain": (url.sub_domain, ("http://a.b.example.com/x",), "example.com"), "domain co.uk": (url.sub_domain, ("https://a.example.co.uk",), "example.co.uk"), "domain ip": (url.sub_domain, ("http://10.0.0.1:8/x",), "10.0.0.1"),
    "option": (lambda u: "|".join(map(str, url.split_option(u))), ('http://h/a , {"b":1}',), 'http://h/a|{"b":1}'), "no option": (lambda u: str(url.split_option(u)[1]), ("http://h/a,b",), "None"), "page 2": (lambda u: url.page_list(u, 2), ("/p<1,2,3>",), "/p2"), "page beyond": (lambda u: url.page_list(u, 9), ("/p<,2,3>",), "/p3"),
    "query": (url.encode_query, ("q=中 a",), "q=%E4%B8%AD%20a"), "query gbk": (lambda t: url.encode_query(t, "gbk"), ("你",), "%C4%E3"), "encoded": (url.encode_query, ("q=%E4%B8%AD",), "q=%E4%B8%AD"), "form": (url.encode_form, ("a=b c&d=中",), "a=b+c&d=%E4%B8%AD"), "escape": (url.js_escape, ("a 中é",), "a%20%u4E2D%E9"),
    "is absolute": (lambda u: str(url.is_absolute(u)), ("HTTP://x",), "True"), "is data": (lambda u: str(url.is_data_url(u)), ("data:x;base64,",), "True"), "is json": (lambda u: str(url.is_json(u)), (" [1] ",), "True"), "is xml": (lambda u: str(url.is_xml(u)), ("<a>",), "True"),
    "canonical": (url.canonical, ("HTTP://User:p@EXAMPLE.com:80/a b/./c/../d?q=中 '#f",), "http://User:p@example.com/a%20b/d?q=%E4%B8%AD%20%27#f"), "canonical empty": (url.canonical, ("https://h:443",), "https://h/"), "canonical port": (url.canonical, ("http:\\\\h:8080\\x\\",), "http://h:8080/x/"),
    "canonical idn": (url.canonical, ("http://bücher.example/é%2f",), "http://xn--bcher-kva.example/%C3%A9%2f"), "canonical bad": (url.canonical, ("ftp://h/",), None), "http relative": (url.canonical, ("../x?y", "http://h/a/b/c?d#e"), "http://h/a/x?y"), "http same": (url.canonical, ("#z", "http://h/a?d"), "http://h/a?d#z"),
    "http scheme": (url.canonical, ("//o/p", "https://h/a"), "https://o/p"), "http query": (url.canonical, ("?n=1", "http://h/a/b?d"), "http://h/a/b?n=1"), "http up": (url.canonical, ("/a/../../%2e%2E/b", "http://h/"), "http://h/b"), "http v6": (url.canonical, ("http://[0:0::1]/",), "http://[::1]/"),
    "key": (lambda u: requests.request_key("GET", u, None), ("http://h/",), None), "java double": (lambda v: render.java_double(float(v)), ("1e10",), "1.0E10"), "java small": (lambda v: render.java_double(float(v)), ("0.0001",), "1.0E-4"), "json text": (lambda v: render.json_text(json.loads(v)), ('{"a":[1,2.0]}',), '{"a":[1,2.0]}'),
    "render map": (lambda v: render.value_string(json.loads(v)), ('{"a":[1,null,true]}',), "{a=[1, null, true]}"),
}
_URLS.pop("key")


@cases("cases_urls", {k: v[2] for k, v in _URLS.items()})
def _urls(spark):
    table = {k: f for k, (f, _, _) in _URLS.items()}
    rows = spark.createDataFrame([(k, json.dumps(a)) for k, (_, a, _) in _URLS.items()], "`case` string, a string")
    return rows.select("case", column_function(lambda k, a: table[k](*json.loads(a)))("case", "a").alias("value"))


@cases("cases_requests", {"get": "GET http://h.x/s?q=%E4%B8%AD&p=2 None", "post": "POST http://h.x/s a=%E4%B8%AD", "json body": 'POST http://h.x/s {"a":1}', "head": "HEAD http://h.x/s None", "headers": "X=1,Referer=r", "retry, charset, type": "2 gbk zip", "bad page": None, "source headers": "X=1", "agent": "true", "redirect": "http://h.x/b 1 body", "relative redirect": "http://h.x/d/e 1 deep", "307 post": "http://h.x/p 0 kept", "post to get": "http://h.x/b 1 body", "miss": "snapshot_miss", "loop": "too_many_redirects", "other scheme": "http://h.x/f 0 stop", "data": "hi", "not followed": "http://h.x/a 0 first", "hex": "6869", "prolog": '<?xml version="1.0" encoding="utf-8"?><a/>'})
def _requests(spark):
    def shown(rule: str, key: str) -> str:
        r = requests.build_request(rule, "http://h.x/y", key, 2, {"X": "1"} if "referer" in rule.lower() else None)
        if "referer" in rule.lower():
            return ",".join(f"{k}={v}" for k, v in r.headers)
        return f"{r.retry} {r.charset} {r.type}" if "retry" in rule else f"{r.method} {r.url} {r.body}"

    built = [("get", "/s?q={{key}}&p={{page}}"), ("post", '/s,{"method":"post","body":"a={{key}}"}'), ("json body", '/s,{"method":"POST","body":{"a":1}}'), ("head", '/s,{"method":"HEAD"}'), ("headers", '/s,{"headers":{"Referer":"r"}}'), ("retry, charset, type", '/s,{"retry":2,"charset":"gbk","type":"zip"}')]
    out = spark.createDataFrame(built, "`case` string, a string").select("case", column_function(lambda a: shown(a, "中"))("a").alias("value"))
    bad = spark.createDataFrame([("bad page", "/p<1,2>")], "`case` string, a string").select("case", column_function(lambda a: requests.build_request(a, "http://h.x", "k", 0).url)("a").alias("value"))
    heads = spark.createDataFrame([("source headers", '{"X":1}'), ("agent", "{bad")], "`case` string, a string")
    heads = heads.select("case", column_function(lambda c, a: f"X={requests.source_headers(a)['X']}" if c[0] == "s" else str("User-Agent" in requests.source_headers(a)).lower())("case", "a").alias("value"))
    asked = [("redirect", "GET", "http://h.x/a", None, True), ("relative redirect", "GET", "http://h.x/d/x", None, True), ("307 post", "POST", "http://h.x/p", "b", True), ("post to get", "POST", "http://h.x/q", "b", True), ("miss", "GET", "http://h.x/no", None, True), ("loop", "GET", "http://h.x/loop", None, True), ("other scheme", "GET", "http://h.x/f", None, True), ("data", "GET", "data:text/plain;base64,aGk=", None, True), ("not followed", "GET", "http://h.x/a", None, False)]
    asked = spark.createDataFrame(asked, "`case` string, method string, url string, body string, follow_redirects boolean")
    known = [("GET", "http://h.x/a", None, 302, "http://h.x/b", "first"), ("GET", "http://h.x/b", None, 200, None, "body"), ("GET", "http://h.x/d/x", None, 301, "e", None), ("GET", "http://h.x/d/e", None, 200, None, "deep"), ("POST", "http://h.x/p", "b", 307, "/b", "kept"), ("POST", "http://h.x/q", "b", 303, "/b", None), ("GET", "http://h.x/loop", None, 302, "/loop", None), ("GET", "http://h.x/f", None, 302, "ftp://x/y", "stop")]
    known = spark.createDataFrame([(requests.request_key(m, u, b), s, at, x) for m, u, b, s, at, x in known], "key string, status int, location string, body string")
    got = requests.fetch(asked, known, hops=3)
    got = got.select("case", F.coalesce("_error", F.when(F.col("case") == "data", F.col("response_body")), F.concat_ws(" ", "final_url", F.col("hops").cast("string"), "response_body")).alias("value"))
    raw = spark.createDataFrame([("hex", b"hi", "zip", None), ("prolog", b"<a/>", None, "text/xml")], "`case` string, b binary, t string, c string").select("case", requests.response_text(F.col("b"), F.col("t"), F.col("c")).alias("value"))
    return out.unionByName(bad).unionByName(heads).unionByName(got).unionByName(raw)


@cases("cases_bytes", {"header": "中文", "meta": "中文", "bom": "ab", "detected": "中文测试", "utf-8": "é", "utf-16": "ab", "to bytes gbk": "D6D0", "from bytes gbk": "中", "unhex": "hi", "encodeURI": "a+b%2F%E4%B8%AD", "utc time": "1970/01/01 08:00", "aes": "secret", "width": "Ab1 ", "number": "十二=12", "chapter": "第12章 x", "hmac": "ok", "simplified": "体"})
def _bytes(spark):
    data = [("header", "中文".encode("gbk"), "text/html; charset=GBK"), ("meta", b'<meta charset="gb2312">' + "中文".encode("gbk"), ""), ("bom", b"\xef\xbb\xbfab", ""), ("detected", "中文测试".encode("gb18030"), ""), ("utf-8", "é".encode(), ""), ("utf-16", "ab".encode("utf-16"), "text/html; charset=utf-16")]
    out = spark.createDataFrame(data, "`case` string, a binary, b string").select("case", column_function(lambda a, b: charset.decode(bytes(a), b or None).rpartition(">")[2])("a", "b").alias("value"))
    key = "0123456789abcdef"
    one = spark.createDataFrame([("中", bytes.fromhex("d6d0"), "6869", "a b/中", 0, "secret", "Ａｂ１　", "体")], "t string, b binary, h string, u string, ms long, s string, w string, z string")
    plain = lambda f: column_function(f)
    one = one.select(
        F.hex(scalars.to_bytes(F.col("t"), "gbk")).alias("to bytes gbk"), scalars.from_bytes(F.col("b"), "gbk").alias("from bytes gbk"), scalars.unhex_text(F.col("h")).alias("unhex"), scalars.encode_uri(F.col("u")).alias("encodeURI"),
        scalars.time_format_utc(F.col("ms"), "yyyy/MM/dd HH:mm", 8 * 3600 * 1000).alias("utc time"), scalars.aes_decrypt(scalars.aes_encrypt(F.col("s"), key, "abcdefghijklmnop"), key).alias("aes"), plain(scalars.half_width)("w").alias("width"),
        plain(lambda w: f"十二={scalars.chinese_number('十二')}")("w").alias("number"), plain(lambda w: scalars.chapter_number("第十二章 x"))("w").alias("chapter"),
        plain(lambda s: "ok" if scalars.hmac_hex(s, "HmacSHA256", "k") == __import__("hmac").new(b"k", s.encode(), "sha256").hexdigest() and len(scalars.digest_hex(s, "SHA-1")) == 40 else "bad")("s").alias("hmac"), scalars.simplified(F.col("z")).alias("simplified"),
    )
    return out.unionByName(_long(one, one.columns))


@cases("cases_format", {"paragraphs": "　　　　a\n　　b", "entities": "x y", "comment": "ab", "keep image": 't<img src="http://h.org/a/i.png">', "data-src": '<img src="http://h.org/z.png">', "image option": '<img src="http://h.org/i.jpg,{"headers":{"a":"b"}}">', "ideographic space": "a\n　　　b", "intro": "a\nb", "usehtml": "<usehtml><b>x</b>", "name": "Book", "author": "Someone", "words": "1.2万字", "words text": "9字", "words kept": "about 3", "true": "true", "false": "false", "title": "ab", "note words": "3.5千字", "note rest": "5月1日", "unescape": "<é"})
def _format(spark):
    texts = {"paragraphs": "<p>a</p><br>b", "entities": "x&nbsp;&nbsp;y", "comment": "a<!-- z -->b", "keep image": 't<img src="i.png">', "data-src": "<img data-src='/z.png' src='no.png'>", "image option": """<img src='/i.jpg,{"headers":{"a":"b"}}'>""", "ideographic space": "a\n　b"}
    keep = column_function(lambda k, t: fmt.format_keep_images(t, "http://h.org/a/b") if k in ("keep image", "data-src", "image option", "ideographic space") else fmt.format_text(t))
    out = spark.createDataFrame(list(texts.items()), "`case` string, a string").select("case", keep("case", "a").alias("value"))
    one = spark.createDataFrame([("<p>a</p>b", " <usehtml><b>x</b>", "Book 作者：Someone", "作 者：Someone", 12345, "9", "about 3", "5月1日 3.5千字", "a\r\nb")], "i string, h string, n string, a string, w long, t string, k string, note string, ti string")
    words, rest = fmt.words_of_note(F.col("note"))
    yes = column_function(lambda t: str(fmt.is_true(t)).lower())
    one = one.select(
        fmt.format_intro(F.col("i")).alias("intro"), fmt.format_intro(F.col("h")).alias("usehtml"), fmt.clean_name(F.col("n")).alias("name"), fmt.clean_author(F.col("a")).alias("author"), fmt.word_count(F.col("w")).alias("words"),
        fmt.word_count_of(F.col("t")).alias("words text"), fmt.word_count_of(F.col("k")).alias("words kept"), yes("t").alias("true"), yes(F.lit(" No ")).alias("false"), fmt.title_line(F.col("ti")).alias("title"), words.alias("note words"), rest.alias("note rest"),
        column_function(fmt.unescape)(F.lit("&lt;&#233;")).alias("unescape"),
    )
    return out.unionByName(_long(one, one.columns))


# --- steps

_BOOK = '<h1> New  name </h1><i class=au>作者：Me</i><p class=in>Long<br>intro</p><a class=toc href="toc">t</a><b class=k>x</b><b class=k>y</b><u>20500</u>'


@cases("cases_detail", {"name": "New name", "author": "Me", "kind": "x,y", "words": "2万字", "intro": "Long\nintro", "toc_url": "http://h/toc", "no rename": "Old", "rename": "New name", "toc default": "http://h/b", "kept kind": "k0", "init": "in"})
def _detail(spark):
    rules = {"name": "tag.h1@text", "author": "class.au@text", "kind": "class.k@text", "wordCount": "tag.u@text", "intro": "class.in@html", "tocUrl": "class.toc@href", "canReName": "1"}
    page = spark.createDataFrame([("http://h/b", _BOOK)], "url string, body string")
    one = steps.detail(page, rules).select("name", "author", "kind", F.col("word_count").alias("words"), "intro", "toc_url")
    out = _long(one, one.columns)
    had = page.withColumns({"name": F.lit("Old"), "kind": F.lit("k0")})
    out = out.unionByName(_long(steps.detail(had, {**rules, "canReName": ""}).select(F.col("name").alias("no rename")), ["no rename"]))
    out = out.unionByName(_long(steps.detail(had, rules).select(F.col("name").alias("rename")), ["rename"]))
    rest = steps.detail(had, {"name": "tag.h1@text"}).select(F.col("toc_url").alias("toc default"), F.col("kind").alias("kept kind"))
    inner = steps.detail(spark.createDataFrame([("u", "<div><h1>out</h1></div><div id=x><h1>in</h1></div>")], "url string, body string"), {"init": "id.x", "name": "tag.h1@text"}).select(F.col("name").alias("init"))
    return out.unionByName(_long(rest, rest.columns)).unionByName(_long(inner, ["init"]))


@cases("cases_toc", {"0": "One|http://h/1|false|a|3万字", "1": "Part|Part2|true|v|", "2": "Three|http://h/3|false||", "empty": "toc_empty", "titles": "ch 1,ch 2,ch 3", "current": "Part", "latest": "Three", "total": "3", "new": "2"})
def _toc(spark):
    from .scripts import ScriptRegistry

    rules = {"chapterList": "class.c", "chapterName": "tag.a@text", "chapterUrl": "tag.a@href", "updateTime": "tag.i@text", "isVolume": "tag.u@text", "nextTocUrl": "class.next@href"}
    first = "<p class=c><a href=/1>One</a><i>a 3万字</i></p><p class=c><a href=/3>Three</a></p><p class=c><a>Part</a><u>1</u><i>v</i></p><a class=next href=/t2>n</a>"
    second = "<p class=c><a href=/3>Three</a></p><p class=c><a></a></p><a class=next href=/t>again</a>"
    responses = spark.createDataFrame([("http://h/t", first), ("http://h/t2", second)], "url string, body string")
    books = spark.createDataFrame([("b", "http://h/t", 1, 1), ("none", "http://h/zz", 0, 0)], "book_url string, toc_url string, dur_chapter_index int, total_chapter_num int")
    entries = steps.contents(books, responses, rules)
    shown = F.concat_ws("|", "title", "url", F.col("is_volume").cast("string"), F.coalesce("tag", F.lit("")), F.coalesce("word_count", F.lit("")))
    out = entries.select(F.coalesce(F.col("index").cast("string"), F.lit("empty")).alias("case"), F.coalesce("_error", shown).alias("value"))
    titled = steps.contents(books.where("book_url = 'b'"), responses, {**rules, "formatJs": "number()"}, ScriptRegistry({"number()": lambda v, c: f"ch {c.binding('page')}"}))
    titles = titled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "title"))), lambda x: x["title"]), ",").alias("titles"))
    after = steps.summary(books.where("book_url = 'b'"), entries).select(F.col("dur_chapter_title").alias("current"), F.col("latest_chapter_title").alias("latest"), F.col("total_chapter_num").alias("total"), F.col("last_check_count").alias("new"))
    return out.unionByName(_long(titles, ["titles"])).unionByName(_long(after, after.columns))


@cases("cases_content", {"http://h/1": '　　　　a<img src="http://h/i.png">\n　　\n　　　　b\n　　', "http://h/2": "content_empty", "http://h/9": "snapshot_miss", "volume": "tagged", "image 0": "http://h/i.png bytes", "replaced": '　　A<img src="http://h/i.png">\n　　\n　　b\n　　', "no rule": "http://h/1", "title": "Heading", "sub": "　　　　x\n　　\nmore"})
def _content(spark):
    rules = {"content": "id.t@html", "nextContentUrl": "class.n@href"}
    responses = spark.createDataFrame([("http://h/1", "<div id=t>a<img src=/i.png></div><a class=n href=/1b>n</a>"), ("http://h/1b", "<div id=t>b</div><a class=n href=/2>n</a>"), ("http://h/2", "<div id=t> </div>"), ("http://h/i.png", "bytes"), ("http://h/s", "<h2>Heading</h2><div id=t>x</div><u>more</u>")], "url string, body string")
    chapters = spark.createDataFrame([("http://h/1", "http://h/2"), ("http://h/2", None), ("http://h/9", None)], "url string, next_chapter_url string")
    got = steps.content(chapters, responses, rules)
    out = got.select(F.col("chapter_url").alias("case"), F.coalesce("_error", "content").alias("value"))
    volume = steps.content(spark.createDataFrame([("Part1", "Part", "tagged", True)], "url string, title string, tag string, is_volume boolean"), responses, rules)
    out = out.unionByName(volume.select(F.lit("volume").alias("case"), F.coalesce("_error", "content").alias("value")))
    pictures = steps.images(got.where("chapter_url = 'http://h/1'"), responses)
    out = out.unionByName(pictures.select(F.concat(F.lit("image "), F.col("pos").cast("string")).alias("case"), F.concat_ws(" ", "url", "body").alias("value")))
    one = chapters.where("url = 'http://h/1'")
    out = out.unionByName(steps.content(one, responses, {**rules, "replaceRegex": "##a(?=<)##A"}).select(F.lit("replaced").alias("case"), F.col("content").alias("value")))
    out = out.unionByName(steps.content(one, responses, {}).select(F.lit("no rule").alias("case"), F.col("content").alias("value")))
    more = steps.content(spark.createDataFrame([("http://h/s",)], "url string"), responses, {"content": "id.t@html", "title": "tag.h2@text", "subContent": "tag.u@text"})
    return out.unionByName(_long(more.select("title", F.col("content").alias("sub")), ["title", "sub"]))


@cases("cases_explore", {"split 0": "a::u1", "split 1": "b::", "split 2": "c::u3", "split 3": "::", "json 0": "T::/x", "json 1": "U::", "script 0": "s::/s", "bad json 0": "ERROR:json", "search": "One http://h/1", "category": "Cat http://h/c1", "failing": "rule_error", "memo": "2"})
def _explore(spark):
    from .scripts import ScriptRegistry

    rules = [("split", "a::u1\nb&&c::u3::x\n"), ("json", ' [{"title":"T","url":"/x"},{"title":"U"}]'), ("script", "@js:kinds()"), ("bad json", "[nothing]"), ("blank", "  ")]
    sources = spark.createDataFrame(rules, "name string, explore_url string")
    kinds = steps.explore_kinds(sources, scripts=ScriptRegistry({"kinds()": lambda v, c: "s::/s"}))
    text = F.when(F.col("title").startswith("ERROR"), F.col("title")).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit("::"), F.coalesce("url", F.lit(""))))
    out = kinds.select(F.concat_ws(" ", "name", F.col("pos").cast("string")).alias("case"), text.alias("value"))
    rule = {"bookList": "class.i", "name": "tag.a@text", "bookUrl": "tag.a@href"}
    records = [json.dumps({"bookSourceUrl": "http://h", "bookSourceName": "h", "searchUrl": "/s?q={{key}}", "exploreUrl": "Cat::/c", "ruleSearch": rule, "ruleExplore": {**rule, "name": "tag.b@text"}}), json.dumps({"bookSourceUrl": "http://bad", "bookSourceName": "b", "searchUrl": "/s", "ruleSearch": {**rule, "name": "@CSS:a:zz@text"}})]
    table = read_sources(spark.createDataFrame([(r,) for r in records], "json string"))
    key = lambda u: requests.request_key("GET", u, None)
    responses = spark.createDataFrame([(key("http://h/s?q=k"), "<p class=i><a href=/1>One</a><b>no</b>"), (key("http://h/c?p=2"), "<p class=i><a href=/c1>no</a><b>Cat</b>"), (key("http://bad/s"), "<p class=i><a href=/1>One</a>")], "key string, body string")
    asked = spark.createDataFrame([(1, "http://h", "k", 1), (3, "http://bad", "k", 1)], "query_id int, source_id string, key string, page int")
    found = by_source.search(table, asked, responses)
    named = F.when(F.col("_error").isNotNull(), F.regexp_extract("_error", "^[^:]*", 0)).otherwise(F.concat_ws(" ", "name", "book_url"))
    out = out.unionByName(found.select(F.when(F.col("query_id") == 1, "search").otherwise("failing").alias("case"), named.alias("value")))
    category = spark.createDataFrame([(2, "http://h", "/c?p={{page}}", 2)], "query_id int, source_id string, url string, page int")
    out = out.unionByName(by_source.search(table, category, responses, "explore").select(F.lit("category").alias("case"), named.alias("value")))
    memo = by_source.kinds_of(table)
    return out.unionByName(by_source.kinds_of(table, memo).unionByName(memo).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("memo").alias("case"), "value"))


# --- chapters

@cases("cases_document", {"0": "title Head 0-4-5", "1": "paragraph a😀 5-8-9", "2": "paragraph x 9-10-10", "3": "image  10-10-27 i.png", "4": "paragraph y 27-28-29", "5": "paragraph  29-29-29", "at 0": "0", "at 9": "2", "at end": "5", "empty": "0", "to source": "7", "to render": "2", "outside": None, "revision": "cbf29ce484222325", "pages": "0-1,2-3,4-5", "gap": "1.0", "oversized": "1", "scroll": "0-5", "page of": "1", "joined": "p0\np1"})
def _document(spark):
    chapters = spark.createDataFrame([("c", " Head ", 'a😀\nx <img src="i.png">y\n')], "chapter_id string, title string, text string").withColumn("text", F.replace("text", F.lit("x <"), F.lit("x<")))
    table = document.blocks(chapters, title="title")
    out = table.select(F.col("block").cast("string").alias("case"), F.concat_ws(" ", "kind", "text", F.concat_ws("-", *[F.col(c).cast("string") for c in ("start", "text_end", "end")]), "src").alias("value"))
    offsets = spark.createDataFrame([("at 0", "c", 0), ("at 9", "c", 9), ("at end", "c", 29)], "`case` string, chapter_id string, offset int")
    out = out.unionByName(document.block_at(offsets, table).select("case", F.col("block").cast("string").alias("value")))
    empty = document.blocks(spark.createDataFrame([("e", None)], "chapter_id string, text string"))
    out = out.unionByName(document.block_at(spark.createDataFrame([("empty", "e", 0)], "`case` string, chapter_id string, offset int"), empty).select("case", F.col("block").cast("string").alias("value")))
    one = spark.createDataFrame([(5, 8, 2, 7, 9)], "s int, e int, r int, p int, o int")
    one = one.select(document.to_source(F.col("s"), F.col("e"), F.col("r")).alias("to source"), document.to_render(F.col("s"), F.col("e"), F.col("p")).alias("to render"), document.to_render(F.col("s"), F.col("e"), F.col("o")).alias("outside"), column_function(lambda o: f"{document.fnv1a(''):x}")("o").alias("revision"))
    out = out.unionByName(_long(one, one.columns))
    lines = spark.createDataFrame([("c", 0, i, 10 * i, 10 * i + 10, 10.0, 0.0) for i in range(6)], "chapter_id string, block int, line_no int, start int, end int, height float, space float")
    spans = lambda df: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "first_line", "last_line"))), lambda x: F.concat_ws("-", x["first_line"].cast("string"), x["last_line"].cast("string"))), ",").alias("v"))
    paged = document.pages(lines, 21.0, align=True)
    out = out.unionByName(spans(paged).select(F.lit("pages").alias("case"), F.col("v").alias("value"))).unionByName(paged.where("page = 0").select(F.lit("gap").alias("case"), F.col("gap").cast("string").alias("value")))
    big = lines.limit(1).withColumn("height", F.lit(50.0).cast("float"))
    out = out.unionByName(document.pages(big, 21.0).select(F.lit("oversized").alias("case"), F.col("oversized").cast("string").alias("value")))
    out = out.unionByName(spans(document.pages(lines, 21.0, scroll=True)).select(F.lit("scroll").alias("case"), F.col("v").alias("value")))
    at = spark.createDataFrame([("c", 25)], "chapter_id string, offset int")
    out = out.unionByName(document.page_of(at, paged).select(F.lit("page of").alias("case"), F.col("page").cast("string").alias("value")))
    parts = spark.createDataFrame([("b", 1, "p1"), ("b", 0, "p0")], "book_url string, page int, text string")
    return out.unionByName(join_pages(parts, "book_url").select(F.lit("joined").alias("case"), F.col("text").alias("value")))


# --- store

@cases("cases_store", {"lookup": "y", "children": "2,1", "sources": "b,a", "count": "3", "replaced": "n1,z", "update": "X", "delta": "1,4", "exists": "true", "shelf": "q,p", "highlights": "h2,h1", "read through": "1/1", "migrated": "1:x:7", "books table": "18", "cookies": "a=1; b=3", "set-cookie": "a=2", "session": "s=9", "cookie": "2", "removed": "e", "imported": "http://h.x", "rules": "ruleSearch.name", "upsert repeats": "1"})
def _store(spark):
    t = spark.createDataFrame([(1, 9, "x"), (2, 9, "y"), (3, 8, "z")], "k int, p int, v string")
    one = lambda case, df, col: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(col).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("value")).select(F.lit(case).alias("case"), "value")
    ordered = lambda df: df.withColumn("o", F.monotonically_increasing_id())
    rows = [
        one("lookup", ordered(store.lookup(t, k=2)), "v"), one("children", ordered(store.children(t.withColumn("i", -F.col("k")), "p", 9, "i")), "k"),
        one("sources", ordered(store.enabled_sources(spark.createDataFrame([("a", 2, True), ("b", 1, True), ("c", 0, False)], "bookSourceUrl string, customOrder int, enabled boolean"))), "bookSourceUrl"),
        store.count(t).select(F.lit("count").alias("case"), F.col("n").cast("string").alias("value")), one("replaced", store.replace_children(t, spark.createDataFrame([(7, 9, "n1")], "k int, p int, v string"), "p").withColumn("o", -F.col("k")), "v"),
        one("update", ordered(store.update(t, spark.createDataFrame([(1, "X")], "k int, v string"), ["k"]).where("k = 1")), "v"),
        one("delta", store.apply_delta(t, spark.createDataFrame([(4, 1, "w")], "k int, p int, v string"), t.where("k > 1"), ["k"]).withColumn("o", F.col("k")), "k"),
        spark.createDataFrame([("exists", str(store.exists(t, F.col("k") == 3) and not store.exists(t, F.col("k") == 5)).lower())], "`case` string, value string"),
        one("shelf", ordered(store.shelf_order(spark.createDataFrame([("p", 1, 5), ("q", 1, 9)], "v string, `order` int, durChapterTime int"))), "v"),
        one("highlights", ordered(store.highlights(spark.createDataFrame([("h1", "b", "c", 0, 5, 6, 1), ("h2", "b", "c", 0, 1, 2, 1)], "id string, book_url string, chapter_url string, chapter_index int, chapter_pos int, chapter_pos_end int, time int"), "b", "c")), "id"),
        one("migrated", ordered(store.migrate(t.where("k = 1"), "k long, name string, extra int", {"v": "name"}, {"extra": 7}).select(F.concat_ws(":", F.col("k").cast("string"), "name", F.col("extra").cast("string")).alias("v"))), "v"),
        spark.createDataFrame([("books table", str(len(store.create(spark, "books").columns))), ("cookies", store.merge_cookies("a=1; b=2", "b=3; c"))], "`case` string, value string"),
    ]
    have, missing = store.read_through(t.select("k").where("k < 3"), t.where("k = 1"), "k")
    rows.append(have.agg(F.count(F.lit(1)).alias("n")).crossJoin(missing.agg(F.count(F.lit(1)).alias("m"))).select(F.lit("read through").alias("case"), F.concat_ws("/", F.col("n").cast("string"), F.col("m").cast("string")).alias("value")))
    kept, session = store.save_cookies("a=1; old=2", "", ["a=2; Max-Age=100", "old=x; Max-Age=0", "s=9; Path=/"], 0)
    rows.append(spark.createDataFrame([("set-cookie", kept), ("session", session), ("cookie", store.cookie_of(store.cookie_header(kept, session), "a"))], "`case` string, value string"))
    jar = spark.createDataFrame([("d", "a=1", 1), ("e", "b=2", 1)], "domain string, cookie string, seq int")
    rows.append(one("removed", ordered(store.without_cookies(store.merged_cookies(jar), jar.where("domain = 'd'").select("domain"))), "domain"))
    records = read_sources(spark.createDataFrame([(json.dumps({"bookSourceUrl": "http://h.x", "bookSourceName": "n", "ruleSearch": {"name": "tag.a@text"}}),), ("{",)], "json string"))
    rows.append(one("imported", ordered(records.where("_error is null")), "bookSourceUrl"))
    rows.append(unpivot_rules(records.where("_error is null")).select(F.lit("rules").alias("case"), F.concat_ws(".", "step", "field").alias("value")))
    twice = store.upsert(t, spark.createDataFrame([(1, 1, "n"), (1, 2, "m")], "k int, p int, v string"), ["k"])
    rows.append(twice.where("k = 1").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("upsert repeats").alias("case"), "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

