"""Connected components of a table of links, by alternating large-star and small-star joins.

Edges stay in Spark tables; each round is two aggregations and two joins and is cut off into the shared folder. A vertex
with very many links only has its own edges re-pointed, and a join over it can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget

#: More rounds than any graph needs: the number grows with the logarithm of the longest chain.
ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root`` for every vertex that has a link to another one; the root is the smallest id in the component.

    Links may repeat and run either way; a link of a vertex with itself and one with a null end are ignored. No links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges = cut(edges, "links")
    before = None
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct(), "links")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        forget(edges)
        edges = after
        # A star forest points every vertex at its root once; the state that a round leaves unchanged is one.
        if seen == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = seen
    raise RuntimeError("components did not settle")
