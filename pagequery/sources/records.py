"""Source records: JSON with about 50 rule strings, read leniently into a fixed schema."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jsonpath import lenient

#: Rule groups and their rules.
GROUPS = {
    "ruleSearch": "checkKeyWord bookList name author intro kind lastChapter updateTime bookUrl coverUrl wordCount".split(),
    "ruleExplore": "bookList name author intro kind lastChapter updateTime bookUrl coverUrl wordCount".split(),
    "ruleBookInfo": "init name author intro kind lastChapter updateTime coverUrl tocUrl wordCount canReName downloadUrls".split(),
    "ruleToc": "preUpdateJs chapterList chapterName chapterUrl formatJs isVolume isVip isPay updateTime nextTocUrl".split(),
    "ruleContent": "content subContent title nextContentUrl webJs sourceRegex replaceRegex imageStyle imageDecode payAction callBackJs".split(),
}
_TEXTS = "bookSourceUrl bookSourceName bookSourceGroup bookUrlPattern concurrentRate header loginUrl loginUi loginCheckJs coverDecodeJs bookSourceComment variableComment exploreUrl exploreScreen searchUrl jsLib".split()
_INTS = {"bookSourceType": 0, "customOrder": 0, "weight": 0}
_LONGS = {"lastUpdateTime": 0, "respondTime": 180000}
_BOOLS = {"enabled": True, "enabledExplore": True, "enabledCookieJar": True}

SCHEMA = ", ".join(
    [*(f"{n} string" for n in _TEXTS), *(f"{n} int" for n in _INTS), *(f"{n} bigint" for n in _LONGS), *(f"{n} boolean" for n in _BOOLS),
     *(f"{g} struct<{', '.join(f'{r}: string' for r in rules)}>" for g, rules in GROUPS.items()), "raw string", "_error string"]
)


class SourceError(ValueError):
    """A record with a value of a kind that can't be taken."""


def _text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (int, float)) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _group(v: Any, rules: list[str]) -> dict[str, str | None] | None:
    if isinstance(v, str):
        if not v.strip():
            return None
        try:
            v = lenient(v)
        except ValueError as e:
            raise SourceError(str(e)) from None
    if not isinstance(v, dict):
        return None
    return {r: _text(v.get(r)) for r in rules}


def parse_source(text: str | None) -> dict[str, Any]:
    """A record's fields; raises SourceError. Texts take any value, whole numbers of a wrong kind their default, long numbers and flags of a wrong kind fail."""
    try:
        v = lenient(text or "")
    except ValueError as e:
        raise SourceError(str(e)) from None
    if not isinstance(v, dict):
        raise SourceError("a record is an object")
    out: dict[str, Any] = {n: _text(v.get(n)) for n in _TEXTS}
    for n in ("bookSourceUrl", "bookSourceName"):
        out[n] = out[n] or ""
    for n, d in _INTS.items():
        out[n] = int(v[n]) if isinstance(v.get(n), (int, float)) and not isinstance(v.get(n), bool) else d
    for n, d in _LONGS.items():
        x = v.get(n, d)
        if isinstance(x, str) and x.strip().lstrip("-").isdigit():
            x = int(x)
        if x is not None and (isinstance(x, bool) or not isinstance(x, (int, float))):
            raise SourceError(f"{n} is no number")
        out[n] = d if x is None else int(x)
    for n, d in _BOOLS.items():
        x = v.get(n, d)
        if isinstance(x, str):
            x = x.strip().lower() == "true"
        if x is not None and not isinstance(x, bool):
            raise SourceError(f"{n} is no flag")
        out[n] = d if x is None else x
    return {**out, **{g: _group(v.get(g), rules) for g, rules in GROUPS.items()}}


def read_sources(records: DataFrame, column: str = "json") -> DataFrame:
    """Records of a text column in the fixed schema, with ``raw`` and, for those that can't be read, ``_error`` ``source_error``."""
    names = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")[: len(_TEXTS) + len(_INTS) + len(_LONGS) + len(_BOOLS)]]
    kinds = {**{n: pa.string() for n in _TEXTS}, **{n: pa.int32() for n in _INTS}, **{n: pa.int64() for n in _LONGS}, **{n: pa.bool_() for n in _BOOLS}}
    types = [(n, kinds[n]) for n in names]
    types += [(g, pa.struct([(r, pa.string()) for r in rules])) for g, rules in GROUPS.items()]
    schema = pa.schema([*types, ("raw", pa.string()), ("_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                try:
                    rows.append({**parse_source(t), "raw": t, "_error": None})
                except SourceError as e:
                    rows.append({"raw": t, "_error": f"source_error: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)

    return records.select(column).mapInArrow(run, SCHEMA)


def import_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON files that hold one record or a list of them; items that can't be read are left out."""
    whole = spark.read.text(path, wholetext=True)

    def listed(text: str | None) -> list[str]:
        try:
            v = lenient(text or "")
        except ValueError:
            return []
        return [json.dumps(x, ensure_ascii=False) for x in (v if isinstance(v, list) else [v])]

    @F.arrow_udf("array<string>")
    def items(texts: pa.Array) -> pa.Array:
        return pa.array([listed(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return read_sources(whole.select(F.explode_outer(items("value")).alias("json")).where("json is not null")).where("_error is null and bookSourceUrl <> ''")


def unpivot_rules(sources: DataFrame) -> DataFrame:
    """One row per rule: source, step, field, rule; rules that aren't set are left out."""
    parts = [F.struct(F.lit(g).alias("step"), F.lit(r).alias("field"), F.col(f"{g}.{r}").alias("rule")) for g, rules in GROUPS.items() for r in rules]
    rows = sources.select("bookSourceUrl", F.explode(F.array(*parts)).alias("x")).select(F.col("bookSourceUrl").alias("source_id"), "x.*")
    return rows.where("rule is not null and rule <> ''")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)
