"""Following next pages: a breadth-first walk over recorded responses, and the reassembly of what the pages hold.

A step joins the frontier with the responses and drops what was visited. The state is the visited table; each round is written to the shared folder, so plans stay small and a lost
executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folder import drop, hold

#: Rounds after which what was found is held as one table again.
FOLD = 32


def follow(start: DataFrame, responses: DataFrame, read: Callable[[DataFrame], DataFrame], key: str = "book_url") -> DataFrame:
    """Pages reached from ``start`` (key, url), each once per key, with their number ``page``.

    ``read`` takes pages (key, url, page, body) and returns them with ``next_urls``; a page that has no response ends its branch with
    ``_error`` ``snapshot_miss``. Chains end where a url was visited before, however long they are.
    """
    frontier = start.select(key, "url").distinct().withColumn("page", F.lit(0)).withColumn("path", F.array(F.lit(0)))
    slim = responses.select("url", "body")
    rounds: list[DataFrame] = []
    while True:
        met = frontier.join(slim, "url", "left")
        got = hold(read(met).withColumn("_error", F.when(F.col("body").isNull(), F.lit("snapshot_miss"))), "pages")
        if got.isEmpty():
            return _union(rounds or [got])
        rounds.append(got)
        if len(rounds) > FOLD:
            rounds = [_folded(rounds[:-1], "pages"), got]
        grown = got.select(key, "page", "path", F.posexplode_outer("next_urls").alias("k", "url")).where("url is not null and url <> ''")
        grown = grown.select(key, "url", (F.col("page") + 1).alias("page"), F.concat("path", F.array("k")).alias("path"))
        grown = grown.groupBy(key, "url").agg(F.min(F.struct("path", "page")).alias("x")).select(key, "url", "x.page", "x.path")
        frontier = grown.join(_union([r.select(key, "url") for r in rounds]), [key, "url"], "left_anti")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _folded(frames: list[DataFrame], name: str) -> DataFrame:
    """Several tables as one; the several are deleted."""
    out = hold(_union(frames), name)
    for f in frames:
        drop(f)
    return out


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def normalise_entries(entries: DataFrame, key: str = "book_url", url: str = "url", pos: str = "pos", reverse: bool = False) -> DataFrame:
    """Entries of a table of contents, each url once and numbered from 0.

    Of equal urls the last survives, in the order given; ``reverse`` keeps the first and turns the order round.
    """
    order = F.col(pos).asc() if reverse else F.col(pos).desc()
    kept = entries.withColumn("_r", F.row_number().over(Window.partitionBy(key, url).orderBy(order))).where("_r = 1").drop("_r")
    by = F.col(pos).desc() if reverse else F.col(pos).asc()
    return kept.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1)


def join_pages(pages: DataFrame, key: str, order: str = "page", text: str = "text") -> DataFrame:
    """Texts of each key's pages in order, joined by line breaks."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias(text))
