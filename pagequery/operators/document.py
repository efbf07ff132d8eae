"""Chapters as blocks with UTF-16 offsets, and pages composed of measured lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.format import utf16_length


def normal_title(title: Column) -> Column:
    """A title in one line, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", ""), "[\n\r]", " ")


def document_text(title: Column, body: Column) -> Column:
    """A chapter's text with its title as the first line; a blank title adds none."""
    line, body = normal_title(title), F.coalesce(body, F.lit(""))
    return F.when(line == "", body).otherwise(F.concat(line, F.lit("\n"), body))


#: Kinds of blocks.
TITLE, PARAGRAPH, IMAGE = "title", "paragraph", "image"
_BLOCK = "struct<block: int, kind: string, text: string, start: int, text_end: int, end: int, src: string>"
_BLOCK_ARROW = pa.struct([("block", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("text_end", pa.int32()), ("end", pa.int32()), ("src", pa.string())])


def _units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text)


def cut(text: str, titled: bool = False) -> list[dict]:
    """Blocks of a chapter that cover it without a gap: lines with the break after them, and image tags, each a block without a text. Blank text before an image belongs to it, and so does
    what is blank between the last image of a line and the next line. The first line is the title, if there is one. Offsets count UTF-16 units."""
    tags = list(images(text))
    out: list[tuple[str, int, int, int, str | None]] = []
    line, at, n = 0, 0, len(text)
    while True:
        end = text.find("\n", line)
        end = n if end < 0 else end
        after = min(end + 1, n)
        kind = TITLE if titled and line == 0 else PARAGRAPH
        run, found = line, False
        while at < len(tags) and tags[at][1] <= end:
            begin, stop, src = tags[at]
            at, found = at + 1, True
            if text[run:begin].strip():
                out.append((kind, run, begin, begin, None))
                run = begin
            out.append((IMAGE, run, run, stop, src))
            run = stop
        if not found or text[run:end].strip():
            out.append((kind, run, end, after, None))
        else:
            out[-1] = (*out[-1][:3], after, out[-1][4])
        line = after
        if end == n:
            break
    # Offsets in characters become UTF-16 units in one pass.
    units, seen, rows = 0, 0, []
    for i, (kind, a, b, c, src) in enumerate(out):
        units += _units(text[seen:a])
        start = units
        middle = start + _units(text[a:b])
        units = middle + _units(text[b:c])
        seen = c
        rows.append({"block": i, "kind": kind, "text": text[a:b], "start": start, "text_end": middle, "end": units, "src": src})
    return rows


def blocks(chapters: DataFrame, key: str = "chapter_id", text: str = "text", title: str | None = None) -> DataFrame:
    """Blocks of chapters, see ``cut``: place, kind, text, half-open interval of UTF-16 units with the end of the text in it, and source of an image.

    Chapters without image tags are split by native expressions; a chapter with some goes through the scanner.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = chapters.select(key, (document_text(F.col(title), body) if title else body).alias("_text"), (normal_title(F.col(title)) != "" if title else F.lit(False)).alias("_titled"))
    plain = rows.where(~F.contains("_text", F.lit("<img"))).select(key, "_titled", F.posexplode(F.split("_text", "\n")).alias("block", "text"))
    order = Window.partitionBy(key).orderBy("block")
    size = utf16_length(F.col("text"))
    brk = F.when(F.lead("block").over(order).isNull(), 0).otherwise(1)
    end = F.sum(F.col("_n") + F.col("_brk")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    plain = plain.withColumns({"_n": size, "_brk": brk}).withColumn("end", end).withColumn("start", F.col("end") - F.col("_n") - F.col("_brk"))
    kind = F.when(F.col("_titled") & (F.col("block") == 0), TITLE).otherwise(PARAGRAPH)
    plain = plain.select(key, "block", kind.alias("kind"), "text", "start", (F.col("start") + F.col("_n")).alias("text_end"), "end", F.lit(None).cast("string").alias("src"))

    @F.arrow_udf(f"array<{_BLOCK}>")
    def scanned(texts: pa.Array, titled: pa.Array) -> pa.Array:
        return pa.array([cut(t, f) for t, f in zip(texts.to_pylist(), titled.to_pylist(), strict=True)], pa.list_(_BLOCK_ARROW))

    with_images = rows.where(F.contains("_text", F.lit("<img"))).select(key, F.explode_outer(scanned("_text", "_titled")).alias("_b")).select(key, "_b.*")
    return plain.unionByName(with_images)


def block_at(offsets: DataFrame, table: DataFrame, key: str = "chapter_id") -> DataFrame:
    """The block that holds each offset: an equi-join on the chapter with a range condition. The offset at a chapter's end is in its last block, and so is 0 in an empty chapter."""
    ends = table.groupBy(key).agg(F.max("block").alias("_last"))
    b = table.join(ends, key).select(F.col(key).alias("_k"), "block", "start", "end", (F.col("block") == F.col("_last")).alias("_final"))
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")) | F.col("_final") & (F.col("offset") == F.col("end"))
    return offsets.join(b, (F.col(key) == F.col("_k")) & inside).drop("_k", "_final")


def to_source(block_start: Column, text_end: Column, render: Column) -> Column:
    """Offset in the chapter of one in a block's text; null outside."""
    at = block_start + render
    return F.when((render >= 0) & (at <= text_end), at)


def to_render(block_start: Column, text_end: Column, source: Column) -> Column:
    """Offset in a block's text of one in the chapter; null outside."""
    return F.when((source >= block_start) & (source <= text_end), source - block_start)


PAGES = "page int, first_line int, last_line int, start int, end int, height float, gap float, oversized int"

#: A page is stretched to its bottom if no gap between lines grows by more than this share of a line.
STRETCH = 1 / 8


def _gap(used: float, ink: float, n: int, height: float) -> float:
    """What is added between lines so that the last one stands at the bottom; 0 where that would show."""
    left = height - used
    if n < 2 or left <= 1e-3:
        return 0.0
    gap = left / (n - 1)
    return gap if gap <= ink / n * STRETCH + 1e-3 else 0.0


def compose(lines: list[dict], height: float, orphans: int = 2, scroll: bool = False, align: bool = False) -> list[dict]:
    """Pages of a chapter's lines (block, line_no, start, end, height, space): filled greedily; a paragraph isn't left with fewer than ``orphans`` lines
    at either side of a break if moving lines helps; space above the first line of a page collapses. Every page holds a line at least. ``gap`` is what stands between lines
    besides, with ``align`` and on all pages but the last; ``oversized`` counts lines that are higher than a page."""
    pages: list[dict] = []
    n, at = len(lines), 0
    while at < n:
        used, end = 0.0, at
        while end < n:
            need = lines[end]["height"] + (lines[end].get("space", 0.0) if end > at else 0.0)
            if not scroll and end > at and used + need > height + 1e-6:
                break
            used += need
            end += 1
        if not scroll and end < n and lines[end]["block"] == lines[end - 1]["block"]:
            block = lines[end]["block"]
            first = next(i for i in range(end, -1, -1) if i == 0 or lines[i - 1]["block"] != block)
            last = next(i for i in range(end, n + 1) if i == n or lines[i]["block"] != block)
            cut = end
            if last - cut < orphans:
                cut = max(last - orphans, first)
            if cut - first < orphans:
                cut = first
            if cut > at:
                end = cut
        some = lines[at:end]
        ink = sum(x["height"] for x in some)
        used = ink + sum(x.get("space", 0.0) for x in some[1:])
        gap = _gap(used, ink, len(some), height) if align and not scroll and end < n else 0.0
        big = 0 if scroll else sum(x["height"] > height + 1e-6 for x in some)
        pages.append({"page": len(pages), "first_line": at, "last_line": end - 1, "start": some[0]["start"], "end": some[-1]["end"], "height": used, "gap": gap, "oversized": big})
        at = end
    return pages


def pages(lines: DataFrame, height: float, key: str = "chapter_id", orphans: int = 2, scroll: bool = False, align: bool = False) -> DataFrame:
    """Pages of every chapter's lines; a chapter is one ordered fold in one task."""
    kind = dict(lines.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["line_no"]))
        out = [{key: rows[0][key], **p} for p in compose(rows, height, orphans, scroll, align)]
        return pa.Table.from_pylist(out, schema=pa.schema([(key, table.schema.field(key).type), ("page", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("height", pa.float32()), ("gap", pa.float32()), ("oversized", pa.int32())]))

    return lines.groupBy(key).applyInArrow(run, f"{key} {kind}, {PAGES}")


def page_of(offsets: DataFrame, table: DataFrame, key: str = "chapter_id") -> DataFrame:
    """The last page that starts at or before each offset."""
    p = table.select(F.col(key).alias("_k"), "page", F.col("start").alias("_s"))
    joined = offsets.join(p, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("offset")), "left")
    return joined.groupBy(*offsets.columns).agg(F.max_by("page", "_s").alias("page"))


def fnv1a(text: str) -> int:
    """Revision of a chapter: 64-bit FNV-1a of its UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def images(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and source of image tags in a text. A tag is in one line; its source is in double quotes, and ends after ``}"`` where options with quotes of their own follow it."""
    at = text.find("<img")
    while at >= 0:
        line = text.find("\n", at)
        line = len(text) if line < 0 else line
        close = text.find(">", at + 4, line)
        if close < 0:  # no tag ends in the rest of the line
            at = text.find("<img", line)
            continue
        src = text.find('src="', at + 4, close)
        quote = text.find('"', src + 5, line) if src >= 0 else -1
        if quote >= 0:
            bound = text.find(">", quote + 1, line)
            option = text.rfind('}"', quote + 2, bound if bound >= 0 else line)
            end_quote = option + 1 if option >= 0 else quote
            end = text.find(">", end_quote + 1, line)
            if end >= 0:
                yield at, end + 1, text[src + 5 : end_quote]
                at = text.find("<img", end + 1)
                continue
        at = text.find("<img", at + 4)
