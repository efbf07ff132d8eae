"""Shared folder and lineage cuts.

``spark.checkpoint.dir`` names the folder that the driver and all executors share. Where it is
unset (tests on a local master) a folder of our own is made and set; on a cluster that is an error,
because a machine-local folder would not be seen by the other machines.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder for this application, removed when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pagequery-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/pagequery-{spark.sparkContext.applicationId}"
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def _fs(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _fs(spark, uri)
    fs.delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage ends there, and a lost
    executor costs a re-read, not a re-computation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``cut`` once nothing reads it any more."""
    remove(df.sparkSession, df._shared_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Up to so many ids (8 bytes each) go to every executor; more are joined by a shuffle.
SEND = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't among ``ids`` (one column); rows with a null id stay."""
    ids = cut(ids.toDF(id_col), "without")
    return docs.join(F.broadcast(ids) if ids.count() <= SEND else ids, id_col, "left_anti").select(*docs.columns)


def unique_ids(slim: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``slim`` (``id``, ``t``) under ids that tell them apart. These are their own, unless some repeat or are null: then the rows are numbered once, in a table
    in the shared folder, and its numbers (``id``) with the ids they stand for (``own``) come second."""
    odd = slim.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return slim, None
    rows = cut(slim.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("own"), "t"), "numbered")
    return rows.select("id", "t"), rows.select("id", "own")
