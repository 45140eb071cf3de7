"""Compaction: hidden versions and tombstones leave the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspark.operators.read import visible


def compact(log: DataFrame, snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """Drop what no reader at ``snapshot`` or later can see.

    A version goes if a newer one of its key is visible at the snapshot; a delete
    goes if it is visible there and no file of ``deeper`` (lo, hi) covers its key.
    """
    newer = F.lag("seq").over(Window.partitionBy("uk").orderBy(F.desc("seq")))
    kept = log.withColumn("__n", newer).where(F.col("__n").isNull() | (F.col("__n") > snapshot)).drop("__n")
    gone = (F.col("vt") == 0) & (F.col("seq") <= snapshot)
    if deeper is None:
        return kept.where(~gone)
    covered = kept.where(gone).join(deeper.select("lo", "hi"), F.expr("uk >= lo AND uk <= hi"), "left_semi")
    return kept.where(~gone).unionByName(covered)


def compact_for(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Keep the newest version of each key for each live snapshot and all after the last.

    The stripes between neighbouring snapshots keep one version each; deletes up to
    the first snapshot go.
    """
    marks = sorted(snapshots)
    stripe = F.lit(len(marks))
    for i, mark in reversed(list(enumerate(marks))):
        stripe = F.when(F.col("seq") <= mark, i).otherwise(stripe)
    order = Window.partitionBy("uk", "__s").orderBy(F.desc("seq"))
    newest = log.withColumn("__s", stripe).withColumn("__r", F.row_number().over(order)).where("__r = 1")
    return newest.where(~((F.col("vt") == 0) & (F.col("seq") <= marks[0]))).drop("__s", "__r")


def compact_range(log: DataFrame, start=None, limit=None, snapshot: int | None = None) -> DataFrame:
    """Rewrite the keys in [start, limit) (null: open); the others stay as they are."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("uk") >= F.lit(start))
    if limit is not None:
        inside = inside & (F.col("uk") < F.lit(limit))
    if snapshot is None:
        snapshot = log.agg(F.max("seq")).first()[0] or 0
    return compact(visible(log.where(inside)), snapshot).unionByName(log.where(~inside))
