"""A training corpus from ``documents``: language ID, exact dedup, near-duplicate join, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.decontaminate import decontaminate
from pagequery.llm.exact_dedup import exact_dedup
from pagequery.llm.jaccard import jaccard_components
from pagequery.llm.language_id import fit, verdict
from pagequery.llm.packing import pack
from pagequery.llm.shared import cut, new_path, read, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; those that the models reject go, and so do null texts and those without a letter. Without labelled documents none stays."""
    rejected = verdict(spark, fit(docs))
    return docs.where(~rejected("text"))


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a column ``_row`` that tells rows apart: the id, unless ids repeat or are null, for which rows are numbered once in a table; and whether it is the id."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("_row", F.col("doc_id")), True
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), False


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest id (any one of those, if its id repeats). A null text counts as empty, and a null id is smaller than any other."""
    rows, plain = _rows(docs)
    if plain:
        gone = exact_dedup(rows, keep="max").where("not kept").select("doc_id")
    else:
        key = F.struct("doc_id", "_row")
        gone = exact_dedup(rows.select(key.alias("key"), "text"), id_col="key", keep="max").where("not kept").select("key._row")
    return without(rows, gone, "_row").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 hold together: the one with the smallest id (any one of those, if its id repeats; one with a null id only if all are null)."""
    rows, plain = _rows(docs)
    groups = jaccard_components(rows, k=5, num=80, den=100, id_col="_row", count_links=False)
    if plain:
        gone = groups.where("component_id <> _row").select("_row")
    else:
        groups = cut(groups.join(rows.select("_row", "doc_id"), "_row"), "groups")
        stay = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("x"))
        gone = groups.select("_row").join(stay.select("x._row"), "_row", "left_anti")
    return without(rows, gone, "_row").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage: those with a window of 13 words of an item, or a whole item of fewer, go, however long they are. An empty benchmark leaves all."""
    rows, _ = _rows(docs)
    hits = decontaminate(rows, read(spark, sf_dir, "benchmark"), window=13, id_col="_row")
    return without(rows, hits.where("size(spans) > 0").select("_row"), "_row").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens."""
    return pack(docs, capacity=4096, end_id=1)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", leaks), ("packing", packing)]

#: SQL can't express the language models, the tokenizer and the packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
