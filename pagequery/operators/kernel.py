"""The fused kernel: all rules over a content column as one struct-returning Arrow function, so each page is parsed once.

The function is deterministic and scalar: filters on other columns stay below it and reach the scan. Plans are compiled on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import format_keep_images, unescape
from ..plans.rule_plan import RulePlan, compile_rule
from ..plans.scripts import ScriptRegistry
from . import css
from . import text as texts
from .evaluate import Content, Context, Evaluator
from .html_tree import Node

TEXT, TEXTS, URL, URLS, BODY = "text", "texts", "url", "urls", "body"
_KINDS = {TEXT: ("string", pa.string()), BODY: ("string", pa.string()), TEXTS: ("array<string>", pa.list_(pa.string())), URL: ("string", pa.string()), URLS: ("array<string>", pa.list_(pa.string()))}


@dataclass(frozen=True)
class Css:
    """All values of an action (text, ownText, wholeText, html, outerHtml, data, attr:name) on the elements of a selector, as a rule of kind TEXTS."""

    selector: str
    action: str

    def values(self, root: Node) -> list[str]:
        read = _ACTIONS.get(self.action) or (lambda n, a=self.action[5:]: n.attr(a))
        return [read(n) for n in css.select(root, self.selector)]


_ACTIONS = {"text": texts.text, "ownText": texts.own_text, "wholeText": texts.whole_text, "html": texts.inner_html, "outerHtml": texts.outer_html, "data": texts.data}


@dataclass(frozen=True)
class Field:
    """A named rule and the kind of its value. ``fails``: an error aborts the row instead of leaving the field null."""

    name: str
    plan: RulePlan | Css
    kind: str = TEXT
    fails: bool = False


@dataclass(frozen=True)
class Spec:
    """Rules of a page: fields, a list rule with the fields of its items, and bindings."""

    fields: tuple[Field, ...] = ()
    items: RulePlan | None = None
    item_fields: tuple[Field, ...] = ()
    bindings: tuple[tuple[str, Any], ...] = ()
    scripts: ScriptRegistry = field(default_factory=ScriptRegistry, compare=False)

    @property
    def keeps_tree(self) -> bool:
        """Whether no rule changes the tree that others read; the action ``html`` takes scripts and styles out."""
        return "html" not in repr((self.fields, self.items, self.item_fields))

    def schema(self) -> str:
        parts = [f"`{f.name}`: {_KINDS[f.kind][0]}" for f in self.fields]
        if self.items is not None:
            inner = ", ".join(["`pos`: int", *(f"`{f.name}`: {_KINDS[f.kind][0]}" for f in self.item_fields)])
            parts.append(f"`_items`: array<struct<{inner}>>")
        return f"struct<{', '.join([*parts, '`_error`: string', '`_field_errors`: array<string>'])}>"

    def arrow(self) -> pa.DataType:
        parts = [(f.name, _KINDS[f.kind][1]) for f in self.fields]
        if self.items is not None:
            parts.append(("_items", pa.list_(pa.struct([("pos", pa.int32()), *((f.name, _KINDS[f.kind][1]) for f in self.item_fields)]))))
        return pa.struct([*parts, ("_error", pa.string()), ("_field_errors", pa.list_(pa.string()))])


def _field(e: Evaluator, f: Field, errors: list[str]) -> Any:
    try:
        if isinstance(f.plan, Css):
            return f.plan.values(e.content.tree())
        if f.kind == TEXT:
            return e.string(f.plan)
        if f.kind == URL:
            return e.string(f.plan, is_url=True)
        if f.kind == BODY:  # plain text with its images
            text = format_keep_images(e.string(f.plan, entities=False), e.context.redirect_url or e.context.base_url)
            return unescape(text) if "&" in text else text
        return e.string_list(f.plan, is_url=f.kind == URLS)
    except Exception as error:  # a rule that fails on this page
        if f.fails:
            raise
        if len(errors) < 20:  # of a page with thousands of items the first ones say enough
            errors.append(f"{f.name}: {type(error).__name__}: {error}"[:200])
        return None


def evaluate_page(spec: Spec, content: str | None, base_url: str | None) -> dict[str, Any]:
    """Values of a spec's fields for one page. A missing content yields empty values; an error is named, not raised: ``_error`` of the page, ``_field_errors`` of fields left null."""
    context = Context(base_url=base_url or "", redirect_url=base_url or "", bindings=dict(spec.bindings), scripts=spec.scripts)
    out: dict[str, Any] = {"_error": None, "_field_errors": None}
    errors: list[str] = []
    try:
        page = Evaluator(Content(content or "", shared=_keeps_tree(spec)), context)
        for f in spec.fields:
            out[f.name] = _field(page, f, errors)
        if spec.items is not None:
            rows = []
            for pos, item in enumerate(page.items(spec.items)):
                e = Evaluator(item, context)
                rows.append({"pos": pos, **{f.name: _field(e, f, errors) for f in spec.item_fields}})
            out["_items"] = rows
    except Exception as error:
        out["_error"] = f"rule_error: {type(error).__name__}: {error}"[:500]
    out["_field_errors"] = errors or None
    return out


_KEEPS: dict[int, tuple[Spec, bool]] = {}


def _keeps_tree(spec: Spec) -> bool:
    held = _KEEPS.get(id(spec))
    if held is None or held[0] is not spec:
        if len(_KEEPS) > 1000:
            _KEEPS.clear()
        held = _KEEPS[id(spec)] = (spec, spec.keeps_tree)
    return held[1]


def page_column(spec: Spec, content: Column, base_url: Column) -> Column:
    """Struct column with the spec's values."""
    kind = spec.arrow()

    @F.arrow_udf(spec.schema())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts_, urls in batches:
            rows = [evaluate_page(spec, t, u) for t, u in zip(texts_.to_pylist(), urls.to_pylist(), strict=True)]
            yield pa.array(rows, kind)

    return run(content, base_url)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a scan gives fewer partitions than there are: a file of one row group is one task, and rules cost far more than moving its pages. Plans with a shuffle
    are left alone, and so are tables with a partition for every core."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(x in plan for x in ("Exchange", "Python", "Arrow")):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_page(df: DataFrame, spec: Spec, content: str, base_url: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and those of the spec. They come through a generator: filters on the spec's columns then stay above the function instead of calling it again, and filters on the
    others go below it."""
    rows = spread(df)
    return rows.select(*keep, F.inline_outer(F.array(page_column(spec, F.col(content), F.col(base_url)))))


def rule_field(name: str, rule: str | tuple[str, str] | Css, fails: bool = False) -> Field:
    """Field of a rule, or of (rule, kind)."""
    if isinstance(rule, Css):
        css.compile_selector(rule.selector)
        if rule.action not in _ACTIONS and not rule.action.startswith("attr:"):
            raise ValueError(f"unknown action {rule.action!r}")
        return Field(name, rule, TEXTS, fails)
    rule, kind = (rule, TEXT) if isinstance(rule, str) else rule
    return Field(name, compile_rule(rule), kind, fails)


def extract(df: DataFrame, rules: dict[str, Any], content: str = "html", base_url: str = "url", bindings: dict[str, Any] | None = None, scripts: ScriptRegistry | None = None, report: str | None = None) -> DataFrame:
    """Add a column for each rule, and ``_error``; with ``report`` a column of that name with the errors of single rules. Rules that only replace run as native columns."""
    from ..plans.native import native_column

    native = {n: c for n, r in rules.items() if (c := native_column(r, F.col(content))) is not None}
    spec = Spec(tuple(rule_field(n, r) for n, r in rules.items() if n not in native), bindings=tuple((bindings or {}).items()), scripts=scripts or ScriptRegistry())
    new = {*rules, "_error", *([report] if report else [])}
    kept = [c for c in df.columns if c not in new]
    last = [report] if report else []
    if not spec.fields:
        return df.select(*kept, *[c.alias(n) for n, c in native.items()], F.lit(None).cast("string").alias("_error"), *[F.lit(None).cast("array<string>").alias(n) for n in last])
    held = {n: f"_native_{i}" for i, n in enumerate(native)}
    out = with_page(df.select("*", *[native[n].alias(h) for n, h in held.items()]), spec, content, base_url, [*kept, *held.values()])
    return out.select(*kept, *[F.col(f"`{held.get(n, n)}`").alias(n) for n in rules], "_error", *[F.col("_field_errors").alias(n) for n in last])


def extract_list(df: DataFrame, list_rule: str, item_rules: dict[str, Any], content: str = "html", base_url: str = "url", bindings: dict[str, Any] | None = None, scripts: ScriptRegistry | None = None) -> DataFrame:
    """A row for each item of a list rule, with its place ``pos`` on the page and a column for each rule. Pages without items give no rows; one whose rules fail gives a row with ``_error``."""
    spec = Spec((), compile_rule(list_rule, listing=True), tuple(rule_field(n, r) for n, r in item_rules.items()), tuple((bindings or {}).items()), scripts or ScriptRegistry())
    kept = [c for c in df.columns if c != content]
    return items_of(with_page(df, spec, content, base_url, kept), kept)


def items_of(pages: DataFrame, kept: list[str]) -> DataFrame:
    """Rows of the items of pages that ``with_page`` made, and of pages with an error."""
    out = pages.select(*kept, "_error", F.explode_outer("_items").alias("_item")).where("_item is not null or _error is not null")
    return out.select(*kept, "_item.*", "_error")


def css_extract(df: DataFrame, selector: str, action: str, content: str = "html", out: str = "values") -> DataFrame:
    """All values of an action on the elements of a selector; see ``Css``, which is the same as a rule beside others."""
    return extract(df.withColumn("_no_url", F.lit("")), {out: Css(selector, action)}, content, "_no_url").drop("_no_url", "_error")


__all__ = ["Css", "Field", "Spec", "css_extract", "evaluate_page", "extract", "extract_list", "items_of", "page_column", "rule_field", "spread", "with_page"]
