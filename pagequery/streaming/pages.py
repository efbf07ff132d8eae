"""Pages as a stream: the same kernel over a file source, urls seen within the watermark dropped."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import extract


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, rules: dict[str, Any], time: str | None = None, delay: str = "1 hour", content: str = "html", url: str = "url") -> DataFrame:
    """Rules over a stream of pages. With a time column, pages of a url that came within the delay before are dropped; state is bounded by it."""
    if time is not None:
        pages = pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])
    return extract(pages, rules, content=content, base_url=url)


def counts_by_host(pages: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour", url: str = "url") -> DataFrame:
    """Pages by host and tumbling window."""
    host = F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)
    return pages.withWatermark(time, delay).groupBy(F.window(time, window), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
