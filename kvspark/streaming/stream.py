"""The log as a stream: replay of its files, and the live view kept up by micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.operators.read import latest
from kvspark.sources.scratch import scratch_dir


def new_rows(seen: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of a replay that come after all that was seen: sequence numbers tell."""
    top = seen.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    return again.join(F.broadcast(top), F.col("seq") > F.col("__top")).drop("__top")


def latest_by_stream(
    spark: SparkSession, path: str, mutations: Callable[[DataFrame], DataFrame], per_trigger: int = 8
) -> DataFrame:
    """uk and val of live keys after all files in ``path`` went through a stream.

    Each micro-batch merges its newest versions with the state and writes the new
    state to a folder of its own number: a batch that runs again writes the same.
    """
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if _is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        rows = mutations(files.option("pathGlobFilter", name).parquet(folder))
    else:
        rows = mutations(files.parquet(path))
    where = f"{scratch_dir(spark)}/kvspark-stream-{uuid.uuid4().hex}"
    last = {"batch": None}

    def merge(batch: DataFrame, number: int) -> None:
        both = latest(batch)
        if last["batch"] is not None and last["batch"] != number:
            both = latest(both.unionByName(spark.read.schema(both.schema).parquet(f"{where}/state/{last['batch']}")))
        both.write.mode("overwrite").parquet(f"{where}/state/{number}")
        last["batch"] = number

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/progress")
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    if last["batch"] is None:
        return latest(mutations(spark.createDataFrame([], schema))).where("vt = 1").select("uk", "val")
    return spark.read.parquet(f"{where}/state/{last['batch']}").where("vt = 1").select("uk", "val")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
