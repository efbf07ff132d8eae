"""The four steps of a source: listing, detail, table of contents and content, over recorded responses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.format import clean_author, clean_name, format_intro, title_line, word_count_of, words_of_note
from ..functions.render import java_string
from ..plans.rule_plan import compile_rule
from ..plans.scripts import ScriptRegistry
from .evaluate import Context
from .frontier import follow, join_pages, keep_first, normalise_entries
from .kernel import BODY, TEXT, TEXTS, URL, URLS, Spec, items_of, page_column, rule_field, with_page

#: Result fields of a list item by the name of their rule, in the order in which they are evaluated.
ITEM_FIELDS = (("name", TEXT), ("author", TEXT), ("kind", TEXTS), ("wordCount", TEXT), ("lastChapter", TEXT), ("intro", TEXT), ("coverUrl", URL), ("bookUrl", URL))
DETAIL_FIELDS = (("name", TEXT), ("author", TEXT), ("kind", TEXTS), ("wordCount", TEXT), ("lastChapter", TEXT), ("intro", TEXT), ("coverUrl", URL), ("tocUrl", URL), ("downloadUrls", URLS))
_COLUMNS = {"name": "name", "author": "author", "kind": "kind", "wordCount": "word_count", "lastChapter": "latest_chapter_title", "intro": "intro", "coverUrl": "cover_url", "bookUrl": "book_url", "tocUrl": "toc_url", "downloadUrls": "download_urls"}


def _fields(rules: dict, which: tuple) -> tuple:
    return tuple(rule_field(_COLUMNS[n], (rules[n], kind), fails=n in ("name", "author", "bookUrl")) for n, kind in which if rules.get(n))


def _shaped(df: DataFrame, names: tuple) -> DataFrame:
    """Columns of the result entity, missing ones null."""
    have = set(df.columns)
    kinds = {"kind": "string", "download_urls": "array<string>"}
    for n, _ in names:
        c = _COLUMNS[n]
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    if "kind" in have:
        df = df.withColumn("kind", F.nullif(F.array_join("kind", ","), F.lit("")))
    if "word_count" in have:
        df = df.withColumn("word_count", word_count_of(F.col("word_count")))
    return df.withColumns({"name": clean_name(F.coalesce("name", F.lit(""))), "author": clean_author(F.coalesce("author", F.lit(""))), "intro": format_intro(F.col("intro"))})


def listing(pages: DataFrame, rules: dict, content: str = "body", url: str = "url", key: str = "page_id", scripts: ScriptRegistry | None = None, bindings: dict | None = None) -> DataFrame:
    """Rows of the list step: items without a name are dropped, each url once (the first), in page order; a leading ``-`` of the list rule turns it round, a ``+`` is ignored.
    A page whose rules fail has a row with ``_error`` and no ``pos``."""
    rule = (rules.get("bookList") or "").strip()
    reverse = rule.startswith("-")
    rule = rule[1:] if rule[:1] in ("-", "+") else rule
    spec = Spec((), compile_rule(rule, listing=True), _fields(rules, ITEM_FIELDS), tuple((bindings or {}).items()), scripts or ScriptRegistry())
    rows = items_of(with_page(pages.withColumn("page_url", F.col(url)), spec, content, "page_url", [key, "page_url"]), [key, "page_url"])
    rows = _shaped(rows, ITEM_FIELDS).where("name <> '' or _error is not null").withColumn("book_url", F.coalesce(F.nullif("book_url", F.lit("")), "page_url"))
    rows = keep_first(rows, [key, "book_url"], "pos")
    return rows.withColumn("pos", -F.col("pos")) if reverse else rows


def detail(pages: DataFrame, rules: dict, content: str = "body", url: str = "url", scripts: ScriptRegistry | None = None, rename: bool = True) -> DataFrame:
    """Rows of the detail step; ``init`` is the part of the page that the other rules read. Pages without a name are dropped; the contents' url is the page's unless a rule says otherwise.

    Where ``pages`` have a ``name`` or ``author`` already, these are overwritten only if both ``rename`` and the source's rule ``canReName`` allow it; what a rule leaves empty
    keeps the value that the page came with."""
    fields = _fields(rules, DETAIL_FIELDS)
    init = (rules.get("init") or "").strip()
    spec = Spec((), compile_rule(init, listing=True), fields, (), scripts or ScriptRegistry()) if init else Spec(fields, scripts=scripts or ScriptRegistry())
    had = {c: f"_had_{c}" for c in pages.columns if c in _COLUMNS.values() and c != url}
    kept = [*[c for c in pages.columns if c != content and c not in had], *had.values()]
    rows = with_page(pages.withColumns({h: F.col(c) for c, h in had.items()}), spec, content, url, kept)
    first = F.get("_items", F.lit(0)) if init else None
    rows = rows.select(*kept, *[(first[f.name] if init else F.col(f"`{f.name}`")).alias(f.name) for f in fields], "_error")
    rows = _shaped(rows, DETAIL_FIELDS)
    may = rename and bool((rules.get("canReName") or "").strip())
    for c, h in had.items():
        new, old = F.nullif(F.col(c), F.lit("")) if c != "download_urls" else F.col(c), F.col(h)
        keep_old = c in ("name", "author") and not may
        rows = rows.withColumn(c, F.coalesce(F.nullif(old, F.lit("")), new) if keep_old else F.coalesce(new, old))
    rows = rows.drop(*had.values()).withColumn("toc_url", F.coalesce(F.nullif("toc_url", F.lit("")), F.col(url)))
    return rows.where("name <> '' or _error is not null")


def contents(books: DataFrame, responses: DataFrame, rules: dict, scripts: ScriptRegistry | None = None) -> DataFrame:
    """Entries of the table of contents of ``books`` (book_url, toc_url), next pages followed: url, title, index, is_volume, is_vip, is_pay, tag, word_count. A book without entries has one row with ``_error`` ``toc_empty``.

    ``formatJs``, where its script is registered, makes the titles; it gets the title as value and ``title``, ``page`` (place from 1) as bindings, and a title for which it fails stays."""
    rule = (rules.get("chapterList") or "").strip()
    reverse = rule.startswith("-")
    rule = rule[1:] if rule[:1] in ("-", "+") else rule
    wanted = (("title", "chapterName", TEXT), ("url", "chapterUrl", URL), ("tag", "updateTime", TEXT), ("volume", "isVolume", TEXT), ("vip", "isVip", TEXT), ("pay", "isPay", TEXT))
    item = tuple(rule_field(n, (rules[r], kind)) for n, r, kind in wanted if rules.get(r))
    fields = (rule_field("next_urls", (rules["nextTocUrl"], URLS)),) if rules.get("nextTocUrl") else ()
    spec = Spec(fields, compile_rule(rule, listing=True), item, (), scripts or ScriptRegistry())

    def read(pages: DataFrame) -> DataFrame:
        p = pages.withColumn("_p", page_column(spec, F.col("body"), F.col("url")))
        none = F.array().cast("array<string>")
        return p.withColumns({"next_urls": F.coalesce("_p.next_urls", none) if fields else none, "_items": F.col("_p._items")}).drop("_p")

    start = books.select("book_url", F.coalesce("toc_url", "book_url").alias("url"))
    pages = follow(start, responses, read)
    rows = pages.select("book_url", F.col("url").alias("base_url"), "page", "path", F.posexplode_outer("_items").alias("k", "_i")).where("k is not null")
    rows = rows.withColumn("pos", F.struct("page", "path", "k")).select("book_url", "base_url", "pos", *[F.col(f"_i.`{f.name}`").alias(f.name) for f in item])
    have = {f.name for f in item}
    for n in ("title", "url", "tag", "volume", "vip", "pay"):
        if n not in have:
            rows = rows.withColumn(n, F.lit(""))
    yes = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "null", "false", "no", "not", "0", "0.0")
    rows = rows.withColumns({"title": title_line(F.coalesce("title", F.lit(""))), "is_volume": yes("volume"), "is_vip": yes("vip"), "is_pay": yes("pay")}).where("title <> ''")
    empty_url = F.when(F.col("is_volume"), F.concat("title", F.col("pos.k").cast("string"))).otherwise(F.col("base_url"))
    rows = rows.withColumn("url", F.when((F.coalesce("url", F.lit("")) == "") | F.col("is_volume") & (F.col("url") == F.col("base_url")), empty_url).otherwise(F.col("url")))
    words, note = words_of_note(F.coalesce("tag", F.lit("")))
    rows = rows.withColumns({"word_count": F.when(~F.col("is_volume"), words), "tag": F.when(F.col("is_volume"), F.col("tag")).otherwise(note)})
    done = normalise_entries(rows, reverse=reverse)
    if script := (rules.get("formatJs") or "").strip():
        done = done.withColumn("title", _titles(script, scripts or ScriptRegistry())("title", "index"))
    done = done.select("book_url", "index", "url", "title", "base_url", "is_volume", "is_vip", "is_pay", "tag", "word_count", F.lit(None).cast("string").alias("_error"))
    missing = books.join(done, "book_url", "left_anti").select("book_url", F.lit(None).cast("int").alias("index"), *[F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("title", "string"), ("base_url", "string"), ("is_volume", "boolean"), ("is_vip", "boolean"), ("is_pay", "boolean"), ("tag", "string"), ("word_count", "string"))], F.lit("toc_empty").alias("_error"))
    return done.unionByName(missing)


def _titles(script: str, scripts: ScriptRegistry):
    """A column function of (title, index)."""
    run = scripts.find(script)

    def one(title: str, index: int) -> str:
        try:
            made = run(title, Context(bindings={"title": title, "page": index + 1}))
        except Exception:  # the title stays
            return title
        return title if made is None else java_string(made)

    @F.arrow_udf("string")
    def titles(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([one(t, i) for t, i in zip(texts.to_pylist(), places.to_pylist(), strict=True)], pa.string())

    return titles


def summary(books: DataFrame, entries: DataFrame) -> DataFrame:
    """``books`` (book_url, dur_chapter_index, total_chapter_num) after their contents were read: titles of the current chapter (the last one if there is no such) and of the latest, number of chapters and how many came
    since; books without entries stay as they are."""
    rows = entries.where("_error is null") if "_error" in entries.columns else entries
    rows = rows.join(books.select("book_url", F.coalesce("dur_chapter_index", F.lit(0)).alias("_at")), "book_url")
    found = rows.groupBy("book_url").agg(
        F.max(F.when(F.col("index") == F.col("_at"), F.col("title"))).alias("_here"), F.max_by("title", "index").alias("_latest"), F.count(F.lit(1)).cast("int").alias("_n")
    )
    before = F.coalesce("total_chapter_num", F.lit(0))
    more = F.col("_n") - before
    old = {c: F.col(c) if c in books.columns else F.lit(None) for c in ("dur_chapter_title", "latest_chapter_title", "last_check_count")}
    return books.join(found, "book_url", "left").withColumns({
        "dur_chapter_title": F.coalesce("_here", "_latest", old["dur_chapter_title"].cast("string")), "latest_chapter_title": F.coalesce("_latest", old["latest_chapter_title"].cast("string")),
        "last_check_count": F.when(more > 0, more).otherwise(F.coalesce(old["last_check_count"].cast("int"), F.lit(0))), "total_chapter_num": F.coalesce("_n", before),
    }).drop("_here", "_latest", "_n")




def content(chapters: DataFrame, responses: DataFrame, rules: dict, scripts: ScriptRegistry | None = None) -> DataFrame:
    """Text of ``chapters`` (url, optionally next_chapter_url): next pages are followed until one was visited or is the next chapter's. Images stay in the text. An
    empty text is ``content_empty``; without a rule the url is the content, and of a volume (is_volume) whose url is its title its tag (blank if it has none)."""
    rule = (rules.get("content") or "").strip()
    if not rule:
        return chapters.select(F.col("url").alias("chapter_url"), F.col("url").alias("content"), F.lit(None).cast("string").alias("_error"))
    fields = [rule_field("text", (rule, BODY))]
    if rules.get("nextContentUrl"):
        fields.append(rule_field("next_urls", (rules["nextContentUrl"], URLS)))
    own = [n for n in ("subContent", "title") if (rules.get(n) or "").strip()]
    fields += [rule_field(n, rules[n]) for n in own]
    spec = Spec(tuple(fields), scripts=scripts or ScriptRegistry())
    stop = chapters.select(F.col("url").alias("chapter_url"), F.col("next_chapter_url").alias("stop")) if "next_chapter_url" in chapters.columns else chapters.select(F.col("url").alias("chapter_url"), F.lit(None).cast("string").alias("stop"))

    def read(pages: DataFrame) -> DataFrame:
        p = pages.join(stop, "chapter_url", "left").withColumn("_p", page_column(spec, F.col("body"), F.col("url")))
        none = F.array().cast("array<string>")
        following = F.filter(F.coalesce("_p.next_urls", none), lambda u: F.coalesce(u != F.col("stop"), F.lit(True))) if rules.get("nextContentUrl") else none
        return p.withColumns({"next_urls": following, "text": F.col("_p.text"), **{n: F.col(f"_p.{n}") for n in own}}).drop("_p", "stop")

    start = chapters.select(F.col("url").alias("chapter_url"), "url")
    pages = follow(start, responses, read, key="chapter_url")
    texts = join_pages(pages.where("text is not null").withColumn("_o", F.struct("page", "path")), "chapter_url", "_o")
    bad = pages.where("page = 0 and _error is not null").select("chapter_url", F.col("_error").alias("miss"))
    own_columns = [c for c in ("title", "tag", "is_volume") if c in chapters.columns]
    out = chapters.select(F.col("url").alias("chapter_url"), *[F.col(c).alias(f"_own_{c}") for c in own_columns]).join(texts, "chapter_url", "left").join(bad, "chapter_url", "left")
    out = out.withColumn("content", F.col("text"))
    first = pages.where("page = 0").select("chapter_url", *own)
    if "subContent" in own:
        # A further part of the content: an address whose response is appended, or the text itself.
        sub = first.join(responses.select(F.col("url").alias("subContent"), F.col("body").alias("_sub")), "subContent", "left")
        out = out.join(sub.select("chapter_url", F.when(F.col("subContent").startswith("http"), F.col("_sub")).otherwise(F.nullif("subContent", F.lit(""))).alias("_part")), "chapter_url", "left")
        out = out.withColumn("content", F.concat_ws("\n", "content", "_part")).drop("_part")
    if "title" in own:
        out = out.join(first.select("chapter_url", F.nullif("title", F.lit("")).alias("title")), "chapter_url", "left")
    if replace := (rules.get("replaceRegex") or "").strip():
        out = _replaced(out, replace)
    blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "[　\\s]+", "")) == ""
    error = F.coalesce("miss", F.when(blank, F.lit("content_empty")))
    if {"title", "is_volume"} <= set(own_columns):
        volume = F.coalesce("_own_is_volume", F.lit(False))
        heading = volume & F.col("chapter_url").startswith(F.col("_own_title"))
        tag = F.coalesce("_own_tag", F.lit("")) if "tag" in own_columns else F.lit("")
        out = out.withColumn("content", F.when(heading, tag).otherwise(F.col("content")))
        error = F.when(heading | volume & F.coalesce("miss", F.lit("")).isin(""), F.lit(None)).otherwise(error)
    return out.select("chapter_url", "content", *[c for c in ("title",) if c in out.columns], error.alias("_error"))


def _replaced(df: DataFrame, rule: str) -> DataFrame:
    """The full-text replacement: lines trimmed, the rule applied, lines indented again."""
    from ..plans.native import replace_all, replace_first
    from ..plans.rule_plan import cut_replacement

    _, pattern, value, first = cut_replacement(rule)
    lines = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, "^[　\\s]+|[　\\s]+$", "")), "\n")
    text = (replace_first if first else replace_all)(lines, pattern, value) if pattern else lines
    return df.withColumn("content", F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("　　"), x)), "\n"))


#: What a tile of a source's categories holds, as JSON has it.
KIND = "title string, url string, type string, action string, default string, viewName string, chars array<string>, style struct<layout_flexGrow: float, layout_flexShrink: float, layout_alignSelf: string, layout_flexBasisPercent: float, layout_wrapBefore: boolean>"


def explore_kinds(sources: DataFrame, rule: str = "explore_url", scripts: ScriptRegistry | None = None) -> DataFrame:
    """Category tiles of sources, by place. A rule in square brackets is a JSON array of tiles; a registered script gives either form; of others, line breaks or ``&&`` stand between tiles and ``::`` between title and
    url, and an empty tail is a tile. Blank rules give none; JSON or a script that fails gives one tile with the title ``ERROR:…``."""
    text = F.coalesce(F.col(rule), F.lit(""))
    made = sources.withColumn("_text", text)
    registry = scripts or ScriptRegistry()

    def run(source: str) -> str:
        try:
            value = registry.find(source)(None, Context())
            return "" if value is None else java_string(value)
        except Exception as error:
            return f"[ERROR:{error}]"

    @F.arrow_udf("string")
    def evaluated(rules: pa.Array) -> pa.Array:
        return pa.array([run(r[4 : r.rfind("<")] if r[:1] == "<" else r[4:]) if r is not None else None for r in rules.to_pylist()], pa.string())

    scripted = text.rlike("(?is)^(@js:|<js>.*<)")
    plain = made.where(~scripted)
    made = plain.unionByName(made.where(scripted).withColumn("_text", evaluated("_text")))
    made = made.where(F.length(F.trim("_text")) > 0)
    as_json = F.trim("_text").startswith("[") & F.trim("_text").endswith("]")
    tiles = F.from_json(F.col("_text"), f"array<struct<{KIND}>>")
    bad = F.array(F.from_json(F.lit("{}"), KIND).withField("title", F.concat(F.lit("ERROR:"), F.when(F.col("_text").startswith("[ERROR:"), F.regexp_extract("_text", "^\\[ERROR:(.*)\\]$", 1)).otherwise(F.lit("json")))))
    bits = lambda x: F.split(x, "::")
    split = F.transform(F.split("_text", "(&&|\n)+"), lambda x: F.from_json(F.lit("{}"), KIND).withField("title", bits(x)[0]).withField("url", F.get(bits(x), F.lit(1))))
    kinds = F.when(as_json, F.coalesce(F.when(~F.col("_text").startswith("[ERROR:"), tiles), bad)).otherwise(split)
    rows = made.select(*sources.columns, F.posexplode_outer(kinds).alias("pos", "_k")).where("pos is not null")
    return rows.select(*[c for c in sources.columns if c not in ("title", "url", "type", "style")], "pos", "_k.*")


def images(chapters: DataFrame, responses: DataFrame, content: str = "content", url: str = "chapter_url") -> DataFrame:
    """Images of chapters with their place and, where it was recorded, the response body."""
    from ..functions.url import absolute, split_option
    from .document import images as tags

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array, bases: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), bases.to_pylist(), strict=True)
        return pa.array([[absolute(base or "", split_option(src)[0]) for _, _, src in tags(text or "")] for text, base in rows], pa.list_(pa.string()))

    rows = chapters.select(F.col(url).alias("chapter_url"), F.posexplode_outer(found(content, url)).alias("pos", "url")).where("pos is not null")
    return rows.join(responses.select("url", "body"), "url", "left")
