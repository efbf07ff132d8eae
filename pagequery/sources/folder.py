"""Tables in the folder that the driver and all executors share, by which lineage is cut.

``spark.checkpoint.dir`` names the folder. Where it is unset (tests on a local master) a folder of our own is made and set; on a cluster that is an error,
because a machine-local folder would not be seen by the other machines.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """URI of this application's part of the shared folder, removed when the driver ends."""
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


def hold(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: its lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``hold`` once nothing reads it any more."""
    fs, path = _fs(df.sparkSession, df._held_at)
    fs.delete(path, True)
