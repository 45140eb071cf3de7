"""Tables for the time of a query, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that isn't set a temporary folder, for local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sys.__dict__.get("_kvspark_local") or tempfile.mkdtemp(prefix="kvspark-")
        sys._kvspark_local = found
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its plan is one scan, however often it is used.

    Every executor can read the files, so that losing one loses nothing. They go when
    ``discard`` is called, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kvspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``settled`` made and that nothing reads any more."""
    _drop(df.sparkSession, df._settled_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        pass
