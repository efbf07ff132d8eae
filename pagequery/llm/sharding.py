"""Sharding by balanced label propagation.

Documents with equal texts are linked. They start in shards chosen by a hash of the id; in each round a join gives every group's members
the shard where most of them are already, and they move there as far as the quotas allow. Quotas
come from a table of proposed moves by pair of shards, whose size depends on the number of shards only; the driver
cuts the flows until no shard holds more linked rows than its share, and hands back thresholds by pair and priority.

State is one row per group and shard with a count of rows, never pairs of documents, so a group with a third of all rows is 24
numbers. It spreads over as many shards as it fills. Documents without a link balance the rest: the row counts of
any two shards differ by one at most. Ranks come from range partitions and their offsets, so no group or shard is gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SEND, cut, forget

ROUNDS = 16
#: Priorities of a move: by gain, then by hash of the group.
PRIORITIES = 64


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str, by: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one in ``order`` (within its value of ``by``, which leads the order)."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    key = ["_part"] + ([by] if by else [])
    # Partitions times shards at most.
    totals = rows.groupBy(key).agg(F.sum(value).alias("v")).collect()
    before: dict = {}
    offsets = []
    for r in sorted(totals, key=lambda r: r["_part"]):
        k = r[by] if by else None
        offsets.append((*(r[c] for c in key), before.get(k, 0)))
        before[k] = before.get(k, 0) + r["v"]
    kinds = dict(rows.dtypes)
    offsets = spark.createDataFrame(offsets, ", ".join(f"{c} {kinds[c]}" for c in key) + ", _base long")
    running = F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_run", running).join(F.broadcast(offsets), key)
    return out.withColumn(name, F.col("_run") + F.col("_base")).drop("_at", "_part", "_run", "_base")


def row_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the number of rows before each one in ``order``, without a shuffle beside the sort's."""
    spark = df.sparkSession
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("v")).collect()
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["v"]
    offsets = spark.createDataFrame(offsets, "_part long, _base long")
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base")).drop("_at", "_part", "_base")


def admitted(proposed: np.ndarray, load: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest part of the proposed moves, by scaling what flows into a shard, that leaves no shard above its room."""
    x = proposed.astype(float)
    for _ in range(500):
        into = x.sum(axis=0)
        over = load + into - x.sum(axis=1) - room
        tight = (over > 1e-6) & (into > 0)
        if not tight.any():
            break
        x[:, tight] *= np.maximum(0.0, 1 - over[tight] / into[tight])
    return x


def _propagate(cells: DataFrame, shards: int, room: np.ndarray, rounds: int) -> DataFrame:
    spark = cells.sparkSession
    for _ in range(rounds):
        load = np.zeros(shards)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] = r["n"]
        # Neighbours' most frequent shard among those with room left; ties go to one that the group's hash chooses.
        tie = F.pmod(F.xxhash64("h", "shard"), F.lit(1 << 30))
        roomy = F.element_at(F.array(*[F.lit(bool(x)) for x in load < 0.98 * room]), F.col("shard") + 1)
        want = cells.groupBy("h").agg(F.max(F.struct(roomy.alias("roomy"), "n", tie.alias("tie"), F.col("shard").alias("to"))).alias("best"))
        moves = cells.join(want, "h").where("shard <> best.to and best.n >= n").select("h", "shard", F.col("best.to").alias("to"), "n", F.col("best.n").alias("there"))
        gain = F.least(F.lit(15), F.floor(2 * F.log2(F.col("there") + 1)).cast("int"))
        moves = cut(moves.withColumn("p", (gain * 4 + F.pmod(F.xxhash64("h"), F.lit(4))).cast("int")), "moves")
        table = moves.groupBy("shard", "to", "p").agg(F.sum("n").alias("n")).collect()  # shards x shards x priorities at most
        proposed = np.zeros((shards, shards))
        for r in table:
            proposed[r["shard"], r["to"]] += r["n"]
        x = admitted(proposed, load, room)
        left = x.copy()
        parts = []
        for r in sorted(table, key=lambda r: -r["p"]):
            take = min(r["n"], left[r["shard"], r["to"]])
            left[r["shard"], r["to"]] -= take
            if take > 0:
                parts.append((r["shard"], r["to"], r["p"], float(take / r["n"])))
        if x.sum() < 1:
            forget(moves)
            break
        # Rounded up or down by the group's hash, so that small cells move too; a shard that ends above its share by that is mended at the end.
        dither = F.pmod(F.xxhash64("h", "to"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        share = spark.createDataFrame(parts, "shard int, to int, p int, part double")
        gone = moves.join(F.broadcast(share), ["shard", "to", "p"]).withColumn("k", F.floor(F.col("n") * F.col("part") + dither))
        gone = gone.where("k > 0")
        change = gone.select("h", "shard", (-F.col("k")).alias("n")).unionByName(gone.select("h", F.col("to").alias("shard"), F.col("k").alias("n")))
        after = cut(cells.unionByName(change).groupBy("h", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        forget(moves)
        forget(cells)
        cells = after
    return cells


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, gapless from 0).

    The row counts of shards differ by one at most. A null text has no bytes and is linked with empty ones. Rows that repeat are linked with each
    other and each get a slot. With fewer rows than shards some shards stay empty; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("h"))
    slim = cut(slim, "slim")
    counts = slim.groupBy("h", F.pmod(F.xxhash64("id", F.lit(99)), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, "counts")
    linked = counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    linked = cut(linked, "groups")
    cells = cut(counts.join(linked.select("h"), "h", "left_semi"), "cells")
    total = slim.count()
    room = np.array([total // shards + (s < total % shards) for s in range(shards)])
    cells = _propagate(cells, shards, room, rounds)

    # Each cell is a run of ranks in its group and a run of slots in its shard.
    placed = prefix_sums(cells, ["shard", "h"], "n", "slot", by="shard")
    starts = prefix_sums(linked, ["h"], "n", "start").select("h", "start")
    runs = placed.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("shard", "n", "slot"))).alias("runs")).join(starts, "h")
    # A hot text's rows all meet one row of runs: it is sent to them, or, with more groups than that, split by adaptive execution.
    joined = slim.join(F.broadcast(runs) if linked.count() <= SEND // 4 else runs, "h", "left")
    marked = row_index(joined.where("runs is not null"), ["h", "id"], "at").withColumn("rank", F.col("at") - F.col("start"))
    # The run that holds the rank: runs are added up until it is reached.
    zero = F.struct(F.lit(0).cast("long").alias("sofar"), F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("slot"))

    def step(s, r):
        here = (s["shard"] < 0) & (F.col("rank") < s["sofar"] + r["n"])
        found = F.struct(s["sofar"].alias("sofar"), r["shard"].alias("shard"), (r["slot"] + F.col("rank") - s["sofar"]).alias("slot"))
        on = F.struct((s["sofar"] + r["n"]).alias("sofar"), s["shard"].alias("shard"), s["slot"].alias("slot"))
        return F.when(s["shard"] >= 0, s).when(here, found).otherwise(on)

    marked = marked.withColumn("to", F.aggregate("runs", zero, step)).select("id", "size", "crc", F.col("to.shard").alias("shard"), F.col("to.slot").alias("slot"))

    load = np.zeros(shards, dtype=np.int64)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    over = np.maximum(load - room, 0)  # what rounding left above a share; placed with the unlinked rows
    free = np.maximum(room - load, 0)
    base, first = np.cumsum(over) - over, np.cumsum(free) - free
    pick = lambda values, at: F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)
    stay = marked.where(F.col("slot") < pick(room, F.col("shard")))
    spilled = marked.where(F.col("slot") >= pick(room, F.col("shard"))).withColumn("u", F.col("slot") - pick(room, F.col("shard")) + pick(base, F.col("shard")))
    single = row_index(joined.where("runs is null").select("id", "size", "crc"), ["id"], "u").withColumn("u", F.col("u") + int(over.sum()))
    loose = spilled.select("id", "size", "crc", "u").unionByName(single.select("id", "size", "crc", "u"))
    to = F.size(F.filter(F.array(*[F.lit(int(v)) for v in np.cumsum(free)]), lambda v: v <= F.col("u")))
    loose = loose.withColumn("shard", to).withColumn("slot", F.col("u") - pick(first, F.col("shard")) + pick(np.minimum(load, room), F.col("shard")))
    both = stay.unionByName(loose.select("id", "size", "crc", "shard", "slot"))
    return both.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int"), F.col("slot").cast("long"))
