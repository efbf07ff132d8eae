"""Exact de-duplication with DataFrame operations only.

Rows are grouped by a 128-bit content hash, and the bytes inside each group are compared, so that a hash
collision can't merge different texts. The comparison is an aggregate too: a group holds one text only if its
smallest and its largest text are the same. Copies are thus folded before the shuffle, in the map task that
reads them, and a group with a third of all rows leaves one partial row per map task. A group that fails the
comparison (a collision of the 128-bit hash) is split by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size`` (long), ``kept`` and ``text_sha256``.

    ``keep``: ``min`` or ``max``, the id that stays of equal texts. A null text counts as empty, so null and
    empty texts are copies of each other. Rows that repeat with the same id are all returned, count in
    ``group_size`` and share the verdict. Rows with a null id take part in groups; a group of such rows only has a
    null ``keep_id`` and keeps them. An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("h", F.unhex(F.md5("t")))
    groups = rows.groupBy("h").agg(
        best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    groups = groups.select("h", "keep_id", "n", (F.col("lo") == F.col("hi")).alias("same"))
    # Ids only from here: the text has been read, hashed and compared. Most groups have one row and join nothing.
    slim = rows.select("id", "h", F.sha2("t", 256).alias("sha"))
    shared = cut(groups.where("n > 1"), "copies")
    joined = slim.join(shared, "h", "left")
    clean = joined.where("same is null or same").select(
        "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("n"), "sha",
    )
    collided = slim.join(shared.where("not same").select("h"), "h")
    apart = collided.groupBy("h", "sha").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    split = collided.join(apart, ["h", "sha"]).select("id", "keep_id", "n", "sha")
    return clean.unionByName(split).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
