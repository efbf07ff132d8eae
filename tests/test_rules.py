"""The rule language without Spark: splitting, trees, selectors, DOM rules, paths, regular expressions, templates."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagequery.functions import java_regex as jr
from pagequery.functions import url as u
from pagequery.functions.format import is_true, unescape, word_count_text
from pagequery.functions.render import java_double, java_string
from pagequery.functions.scalars import chapter_number, chinese_number, half_width
from pagequery.operators import css, dom, jsonpath, xpath
from pagequery.operators.evaluate import Context, Evaluator, regex_rows
from pagequery.operators.html_tree import parse
from pagequery.operators.text import outer_html, own_text, text
from pagequery.plans.splitter import RuleError, UnsupportedRule, inner_rule, inner_text, merge, split_rule, trim_rule

PAGE = """<html><head><title>A &amp; B</title></head><body><ul id="list"><li class="item hot"><a href="/1">one</a></li>
<li class=item><a href="/2">two</a></li><li class="Item"><a href="/1">three</a></li></ul>
<div class="c"><p>First<br>line</p><p>Second <b>bold</b> tail</p><script>var x='<p>';</script></div></body></html>"""


@pytest.fixture
def tree():
    return parse(PAGE)


def test_first_separator_decides():
    assert split_rule("a&&b||c", ["&&", "||", "%%"]) == (["a", "b||c"], "&&")
    assert split_rule("a[x&&y]||b", ["&&", "||"]) == (["a[x&&y]", "b"], "||")
    assert split_rule("", ["@"]) == ([""], "")
    with pytest.raises(RuleError):
        split_rule("a[b", ["&&"])
    assert trim_rule("@ a") == "a"


@given(st.text(alphabet="abc&|%@ ", max_size=30))
def test_split_without_brackets_is_plain(s):
    parts, sep = split_rule(s, ["&&"])
    assert parts == s.split("&&") and (sep == "&&") == ("&&" in s)


@given(st.lists(st.lists(st.integers(), max_size=4), min_size=1, max_size=3))
def test_merge_laws(lists):
    assert merge(lists, "&&") == [x for y in lists for x in y]
    zipped = merge(lists, "%%")
    assert len(zipped) == sum(min(len(x), len(lists[0])) for x in lists)


def test_inner_templates():
    assert inner_rule("x{$.a}y", "{$.", lambda r: r.upper()) == "x$.Ay"
    assert inner_rule("plain", "{$.", str) == ""
    assert inner_text("a{{k}}b{{n}}", "{{", "}}", {"k": "1"}.get) == "a1bnull"


@pytest.mark.parametrize(
    "html,out",
    [
        ("<p>a<p>b", ["p", "p"]),
        ("<ul><li>1<li>2</ul>", ["ul", "li", "li"]),
        ("<p>a<div>b</div>", ["p", "div"]),
        ("<table><tr><td>1<td>2</table>", ["table", "tbody", "tr", "td", "td"]),
        ("<b><p>x</b>y</p>", ["b", "p", "b"]),
        ("<a>1<a>2", ["a", "a"]),
        ("<select><option>1<option>2</select>", ["select", "option", "option"]),
        ("<h1>a<h2>b", ["h1", "h2"]),
        ("<td>lost", []),
        ("<script><p></script>", []),
        ("<", []),
        ("", []),
    ],
)
def test_tree_shapes(html, out):
    body = next(n for n in parse(html).descendants() if n.tag == "body")
    assert [n.tag for n in body.descendants()][1:] == out


def test_foster_parenting():
    assert text(parse("<table>x<tr><td>y</table>")) == "x y"


@given(st.text(alphabet="<>/apb div='\"!-&;", max_size=60))
def test_parser_never_fails(s):
    outer_html(parse(s))


def test_texts(tree):
    p = css.select(tree, "p")
    assert [text(x) for x in p] == ["First line", "Second bold tail"]
    assert own_text(p[1]) == "Second tail"
    assert text(parse("<p>a&nbsp;b​c­</p>")) == "a bc"
    assert "var x" not in text(tree)


@pytest.mark.parametrize(
    "selector,n",
    [
        ("li", 3), (".item", 3), ("#list > li", 3), ("li.hot a", 1), ("[href]", 3), ("[href=/1]", 2), ("[href!=/1]:not(html,head,body,title)", 11), ("a[href^=/]", 3),
        ("li:first-child", 1), ("li:nth-child(2n+1)", 2), ("li:eq(1)", 1), ("li:lt(2)", 2), ("li:gt(0)", 2), ("p:contains(BOLD)", 1), ("p:containsOwn(bold)", 0),
        ("li:has(a[href=/2])", 1), ("li + li", 2), ("li ~ li", 2), ("li, p", 5), ("p:matches(^First)", 1), ("[href~=\\d]", 3), ("p:last-of-type", 1), ("*|li", 3), ("[^hr]", 3),
    ],
)
def test_selectors(tree, selector, n):
    assert len(css.select(tree, selector)) == n


@pytest.mark.parametrize("bad", ["", "li:only-of-type", "[a^=]", "li >", ":eq(x)"])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.compile_selector(bad)


@pytest.mark.parametrize(
    "rule,out",
    [
        ("class.item@tag.a@text", ["one", "two", "three"]),
        ("class.item@tag.a@href", ["/1", "/2"]),
        ("id.list@children@text", ["one", "two", "three"]),
        ("tag.li.0@text", ["one"]), ("tag.li.-1@text", ["three"]), ("tag.li.2:0@text", ["three", "one"]), ("tag.li!0@text", ["two", "three"]),
        ("tag.li[0:1]@text", ["one", "two"]), ("tag.li[-1:0]@text", ["three", "two", "one"]), ("tag.li[!0,1]@text", ["three"]), ("tag.li.9@text", []), ("tag.li[0,-1]@text", ["one", "three"]),
        ("text.two@text", ["two"]), ("@CSS:li a@text", ["one", "two", "three"]), ("tag.x@text||tag.li.1@text", ["two"]), ("tag.li.0@text&&tag.title@text", ["one", "A & B"]),
        ("tag.li@text%%tag.p@text", ["one", "First line", "two", "Second bold tail", "three"]), ("tag.p.1@textNodes", ["Second\ntail"]), ("tag.p.1@ownText", ["Second tail"]),
        ("class.c@html", None),
    ],
)
def test_dom_rules(tree, rule, out):
    got = dom.string_list(tree, rule)
    if out is None:
        assert "<script" not in got[0] and "<p>" in got[0]
    else:
        assert got == out


JSON = {"s": {"b": [{"t": "a", "p": 1, "c": ["x"]}, {"t": "b", "p": 2.5}, {"t": "c"}], "k": {"t": "z"}}}


@pytest.mark.parametrize(
    "path,out",
    [
        ("$.s.b[0].t", ["a"]), ("$.s.b[*].t", ["a", "b", "c"]), ("$..t", ["a", "b", "c", "z"]), ("$.s.b[-1].t", ["c"]), ("$.s.b[0,2].t", ["a", "c"]), ("$.s.b[0:2].t", ["a", "b"]),
        ("$.s.b[1:].t", ["b", "c"]), ("$.s.b[?(@.p>1)].t", ["b"]), ("$.s.b[?(@.c)].t", ["a"]), ("$.s.b[?(!@.p)].t", ["c"]), ("$.s.b[?(@.t=='a'||@.p==2.5)].t", ["a", "b"]),
        ("s.b[1].p", ["2.5"]), ("$.s.k", ["{t=z}"]), ("$.none", []), ("$.s.b[0]['t','p']", ["{t=a, p=1}"]), ("$.s.b[0].t&&$.s.k.t", ["a", "z"]), ("$.none||$.s.k.t", ["z"]), ("$.s.b[0].c", ["x"]),
    ],
)
def test_jsonpath(path, out):
    assert jsonpath.string_list(JSON, path) == out


def test_json_texts():
    assert jsonpath.lenient("{a:'b',c=[1,2,],/*x*/d:null}") == {"a": "b", "c": [1, 2], "d": None}
    assert jsonpath.document("plain words") == "plain words"
    with pytest.raises(ValueError):
        jsonpath.document("")
    assert jsonpath.string(JSON, "{$.s.b[0].t}-{$.s.k.t}") == "a-z"
    assert jsonpath.string(JSON, "$.s[") == ""


@pytest.mark.parametrize(
    "path,out",
    [
        ("//li/a/text()", ["one", "two", "three"]), ("//li[2]/a/@href", ["/2"]), ("//li[-1]/a/text()", ["three"]), ("//ul/li[@class='item']/a/text()", ["two"]), ("count(//li)", ["3"]),
        ("//p[contains(text(),'First')]/text()", ["First", "line"]), ("//li[last()]/a/text()", ["three"]), ("//li[position()<3]/a/text()", ["one", "two"]), ("//p[2]/b/text()", ["bold"]),
        ("//li[1]/following-sibling::li/a/text()", ["two", "three"]), ("//b/parent::p/allText()", ["Second bold tail"]), ("//a[@href='/1' and text()='three']/text()", ["three"]),
        ("1+2*3", ["7.0"]), ("substring('hello',2,3)", ["ell"]), ("string-length('a\U0001f600')", ["3"]), ("//li[1]/a/text()|//p[2]/b/text()", ["one", "bold"]),
        ("//x/text()||//b/text()", ["bold"]), ("concat('a',1)", ["a1"]), ("substring-after('a-b','-')", ["b"]), ("//a[@href~='/\\d']/text()", ["one", "two", "three"]),
    ],
)
def test_xpath(path, out):
    assert xpath.string_list(xpath.document(PAGE), path) == out


def test_xpath_errors():
    for bad in ("//li[", "$x", "format-date(1)"):
        with pytest.raises(xpath.XPathError):
            xpath.evaluate(xpath.document(PAGE), bad)


@pytest.mark.parametrize(
    "text_,pattern,replacement,first,out",
    [
        ("ab", "(a)", "$12", False, "a2b"), ("abc汉字", r"\W", "-", False, "abc--"), ("a1b2", r"\d", "<$0>", False, "a<1>b<2>"), ("x", "(", "y", False, "x"), ("a(b", "(", "y", False, "ayb"),
        ("abab", "a(b)", "$1", True, "b"), ("zz", "a", "b", True, ""), ("zz", "(", "b", True, "b"), ("ab", "a", "$5", False, "$5b".replace("$5", "$5")), ("a.b", r"\.", r"\$", False, "a$b"),
    ],
)
def test_replace(text_, pattern, replacement, first, out):
    assert jr.replace(text_, pattern, replacement, first) == out


def test_find_all():
    assert jr.find_all("a1b", r"([a-z])(\d)?") == [["a1", "a", "1"], ["b", "b", None]]
    assert regex_rows("a1b2", [r"[a-z]\d", r"([a-z])(\d)"]) == [["a1", "a", "1"], ["b2", "b", "2"]]


@pytest.mark.parametrize(
    "base,rel,out",
    [
        ("http://h.x/a/b", "c", "http://h.x/a/c"), ("http://h.x/a/b", "/c", "http://h.x/c"), ("http://h.x/a/b?q=1", "?z=2", "http://h.x/a/?z=2"), ("http://h.x/a/b", "../c", "http://h.x/c"),
        ("http://h.x/a/b", "./c", "http://h.x/a/c"), ("http://h.x", "c", "http://h.x/c"), ("http://h.x/a", "//k.y/z", "http://k.y/z"), ("http://h.x/a", "#f", "http://h.x/a#f"),
        ("http://h.x/a", "javascript:void(0)", ""), ("", " c ", "c"), ("nonsense", "c", "c"), ("http://h.x/a,{\"m\":1}", "c", "http://h.x/c"), ("http://h.x/a", "https://k.y/z", "https://k.y/z"),
    ],
)
def test_absolute(base, rel, out):
    assert u.absolute(base, rel) == out


def test_url_helpers():
    assert u.split_option('http://h/x , {"a":1}') == ("http://h/x", '{"a":1}')
    assert u.page_list("p<a,b,c>", 2) == "pb" and u.page_list("p<a,b>", 9) == "pb"
    assert u.sub_domain("http://www.a.co.uk/x") == "a.co.uk" and u.sub_domain("http://1.2.3.4/x") == "1.2.3.4"
    assert u.encode_query("a=中") == "a=%E4%B8%AD" and u.encode_query("a=%20") == "a=%20"
    assert u.js_escape("a 中") == "a%20%u4E2D"


def test_rules_with_templates():
    e = Evaluator(PAGE, Context(base_url="http://h.x/p/q", redirect_url="http://h.x/p/q", bindings={"page": 3, "key": "k"}))
    assert e.string("tag.title@text") == "A & B"
    assert e.string("p={{page}}&k={{key}}-{{@@tag.a.1@text}}") == "p=3&k=k-two"
    assert e.string('@put:{"v":"tag.a.0@text"}tag.a.1@text') == "two" and e.string("@get:{v}!") == "one!"
    assert e.string("{{(page-1)*20}}") == "40"
    assert e.string_list("tag.a@text##(t)##<$1>") == ["one", "<t>wo", "<t>hree"]
    assert e.string("tag.a.0@text##n##N###") == "N"
    assert e.string_list("tag.a@href", is_url=True) == ["http://h.x/1", "http://h.x/2"]
    assert e.string("tag.none@href", is_url=True) == "http://h.x/p/q" and e.string_list("tag.none@href", is_url=True) == []
    rows = e.items(':<a href="(.*?)">(\\w+)')
    assert [Evaluator(r, e.context).string("$2=$1") for r in rows] == ["one=/1", "two=/2", "three=/1"]
    with pytest.raises(UnsupportedRule):
        e.string("<js>java.ajax(1)</js>")
    j = Evaluator('{"a":[{"t":"x"},{"t":"y"}]}')
    assert [Evaluator(x).string("$.t") for x in j.items("$.a")] == ["x", "y"]


def test_variables():
    c = Context(layers={"book": {}, "source": {"k": "s"}})
    assert c.get("k") == "s"
    c.put("k", "b")
    assert c.get("k") == "b" and c.layers["source"]["k"] == "s"


def test_rendering():
    assert [java_double(x) for x in (1.0, 1e10, 0.001, 1e-4, 123456.5, -0.0)] == ["1.0", "1.0E10", "0.001", "1.0E-4", "123456.5", "-0.0"]
    assert java_string({"a": [1, None, True]}) == "{a=[1, null, true]}"
    assert unescape("&lt;&apos;&#65;&amp") == "<&apos;A&amp"
    assert [word_count_text(x) for x in ("123456", "9999", "abc", None, "0", "10500")] == ["12.3万字", "9999字", "abc", "", "", "1万字"]
    assert [is_true(x) for x in ("1", "no", "", None, "False", "yes")] == [True, False, False, False, False, True]
    assert chinese_number("一千零二十三") == 1023 and chapter_number("第十二章 x") == "第12章 x" and half_width("ＡＢ　１") == "AB 1"
