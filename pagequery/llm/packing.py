"""Best-fit packing by the sum of squares.

Documents become token ids once, in Arrow batches; from then on only (id, piece, length) travels. Pieces are
dealt evenly to groups of bounded size, and each group is packed on its own: a piece goes to the open sequence
whose use leaves the smallest sum of squares of N(gap), where N(gap) counts open sequences with that gap. A new sequence is
opened only if no open one has room. The on-line rule weighs that choice too, since it doesn't know what comes; here pieces come largest first, all
of them known, and a sequence opened early could only add to their number. Where there are several groups, what they leave less than ``FULL`` is packed
once more in groups dealt anew; this concerns placement alone, and no piece is left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import slices
from .shared import cut
from .tokens import default_path, encoder

#: Pieces that one task packs at once, on average.
GROUP = 1 << 16

#: Sequences below this share of the capacity are packed again with those of other groups.
FULL = 0.97


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items are placed largest first (ties by position); a bin is opened only if none has room."""
    n = len(lengths)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; a full one isn't open
    open_at: dict[int, list[int]] = defaultdict(list)
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # Change of the sum when a sequence with gap g becomes one with gap g - size, for each g from size up.
        after = count[: capacity + 1 - size]
        delta = 2 * (after - count[size:]) + 2
        delta[0] -= 1  # gap size becomes 0, which isn't counted
        if size == 0:
            delta[:] = 0
        delta = np.where(count[size:] > 0, delta, np.iinfo(np.int64).max)
        best = int(np.argmin(delta))
        if delta[best] < np.iinfo(np.int64).max:
            gap = size if delta[0] < np.iinfo(np.int64).max else best + size  # one that becomes full is never worse
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - size > 0:
            count[gap - size] += 1
            open_at[gap - size].append(b)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (id, text): place in the document, length and CRC-32 of the ids; the ids too on request."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.uint32(end_id)
        for batch in batches:
            for ids, data, offs in slices(batch.column(0), batch.column(1)):
                tokens, bounds = encode(data, offs)
                tokens = np.insert(tokens, bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                count = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(ids)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                begin = bounds[doc] + piece * capacity
                stop = np.minimum(begin + capacity, bounds[doc + 1])
                raw = memoryview(tokens.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                columns = [ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(stop - begin), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, bounds[-1]), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(kernel, schema)


def pack(
    docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every document in sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids and ``end_id``; one that is longer than
    ``capacity`` is cut into full pieces and a rest. A null or empty text is ``end_id`` alone. Rows that repeat are
    packed as often as they occur; ties go to the row that comes first in its group. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    cutting = cut(pieces(slim, capacity, tokenizer or default_path(), end_id), "pieces")
    n = cutting.count()
    first = cut(_packed(cutting, n, capacity, 0), "packed")
    if n <= GROUP:
        return first
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < int(FULL * capacity))
    loose = cut(first.join(fill, "sequence_id", "left_semi").drop("sequence_id", "offset"), "loose")
    again = _packed(loose, loose.count(), capacity, 1)
    return first.join(fill, "sequence_id", "left_anti").unionByName(again)


def _packed(rows: DataFrame, n: int, capacity: int, level: int) -> DataFrame:
    groups = max(1, -(-n // GROUP))
    names = rows.columns

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Order of arrival differs from run to run; a fixed order makes the result the same.
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        # Numbers of a level and group are apart: level, then group, then sequence.
        return rows.assign(sequence_id=(level << 62) + (int(key[0]) << 32) + bins, offset=offsets)[[*names, "sequence_id", "offset"]]

    schema = f"{rows._jdf.schema().toDDL()}, sequence_id long, offset long"
    # By place in the table, which its files fix: rows that repeat are dealt out as well.
    dealt = rows.withColumn("g", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(lambda key, rows: run(key, rows.drop(columns="g")), schema)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences: ``sequence_id`` and its ``ids``, from the placement that ``pack`` returned. Ids of documents must be unique."""
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    ids = pieces(slim, capacity, tokenizer or default_path(), end_id, with_ids=True)
    rows = placed.join(ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
