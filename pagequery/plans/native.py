"""Lowering of rules to native columns: what Spark's own expressions say stays in the JVM."""

from __future__ import annotations

import re
from typing import Any

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.java_regex import ReplacementError, compile_java, expand
from .rule_plan import REGEX, compile_rule


def valid(pattern: str, replacement: str) -> bool:
    """Whether Java takes both; a pattern or replacement that it refuses must not reach Spark."""
    try:
        p = compile_java(pattern)
        if re.search(r"\(\?<[a-zA-Z]|\(\?P|\\[pPGXRv]", pattern):
            return False
        groups = [int(g) for g in re.findall(r"(?<!\\)\$(\d)", replacement)]
        return all(g <= p.groups for g in groups) and not re.search(r"(?<!\\)\$(?!\d)|\\$", replacement) and expand is not None
    except (regex.error, ReplacementError):
        return False


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; with an invalid pattern or replacement, plain occurrences of the pattern."""
    if valid(pattern, replacement):
        return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return F.replace(text, F.lit(pattern), F.lit(replacement))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """The first match, replaced inside; empty without one; the replacement if the pattern is invalid."""
    if not valid(pattern, replacement):
        return F.lit(replacement)
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 0), F.lit(pattern), F.lit(replacement))).otherwise("")


def _once(pattern: str) -> bool:
    """Whether a match can't hold a second, different match: no look-around, anchors, lazy or optional parts."""
    return not re.search(r"\(\?|[*?{^$]|\\b|\\B|\|", pattern)


def native_column(rule: Any, content: Column) -> Column | None:
    """Column of a rule that only replaces in the content, or None if it needs the kernel."""
    if not isinstance(rule, str) or not rule.startswith("##"):
        return None
    plan = compile_rule(rule)
    if len(plan.segments) != 1:
        return None
    s = plan.segments[0]
    if s.parts or s.puts or s.rule or not s.pattern or s.mode == REGEX:
        return None
    if s.first:
        return replace_first(F.coalesce(content, F.lit("")), s.pattern, s.replacement) if _once(s.pattern) and valid(s.pattern, s.replacement) else None
    out = replace_all(F.coalesce(content, F.lit("")), s.pattern, s.replacement)
    return F.when(F.instr(out, "&") > 0, F.try_reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), out)).otherwise(out)


def merge_and(*lists: Column) -> Column:
    """``&&``: one after the other."""
    return F.concat(*lists)


def merge_or(*lists: Column) -> Column:
    """``||``: the first that isn't empty."""
    none = F.array().cast("array<string>")
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], none)


def merge_zip(*lists: Column) -> Column:
    """``%%``: in turns, over the length of the first."""
    first = lists[0]
    turns = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.filter(F.array(*[F.get(x, i) for x in lists]), lambda v: v.isNotNull()))
    return F.when(F.size(first) > 0, F.flatten(turns)).otherwise(F.array().cast("array<string>"))


def regex_rows(text: Column, pattern: str, groups: int) -> Column:
    """Rows of a pattern's groups, whole match first."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(groups + 1)])


def variable(key: str, *layers: Column) -> Column:
    """A variable from the first layer (a map) that has something for it."""
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(key)), F.lit("")) for m in layers], F.lit(""))
