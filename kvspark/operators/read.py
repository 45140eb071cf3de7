"""Reads of a mutation log: points, ranges, snapshots, histories.

The snapshot bound is a filter below the aggregation, the tombstone filter stands
above it. The newest version of a key is ``max_by``, which aggregates on the map
side, so that a hot key costs a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.functions.keys import Order, bytewise


def visible(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """uk, seq, vt, val of the newest visible version of each key, deletes included."""
    newest = visible(log, as_of).groupBy("uk").agg(F.max_by(F.struct("seq", "vt", "val"), "seq").alias("n"))
    return newest.select("uk", "n.seq", "n.vt", "n.val")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """uk and val of the keys that aren't deleted."""
    return latest(log, as_of).where("vt = 1").select("uk", "val")


def scan(log: DataFrame, as_of: int | None = None, order: Order = bytewise, descending: bool = False) -> DataFrame:
    key = order(F.col("uk"))
    return live(log, as_of).orderBy(key.desc() if descending else key.asc())


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    return live(log.where(F.col("uk") == F.lit(key)), as_of)


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """uk, status (absent, deleted, value) and val for each row of ``keys``."""
    wanted = log.join(keys.select("uk").distinct(), "uk", "left_semi")
    found = keys.select("uk").join(latest(wanted, as_of), "uk", "left")
    status = F.when(F.col("vt").isNull(), "absent").when(F.col("vt") == 0, "deleted").otherwise("value")
    return found.select("uk", status.alias("status"), F.when(F.col("vt") == 1, F.col("val")).alias("val"))


def asof_join(log: DataFrame, probes: DataFrame) -> DataFrame:
    """snap, uk, vt, val: the newest version with seq <= snap for each (uk, snap).

    One sort by key and sequence number, in which a probe follows the versions that
    it sees: linear in both inputs, however many versions a key has.
    """
    sides = log.select("uk", F.col("seq").alias("at"), F.lit(0).alias("probe"), F.struct("vt", "val").alias("n"))
    sides = sides.unionByName(probes.select("uk", F.col("snap").cast("long").alias("at"), F.lit(1).alias("probe")), allowMissingColumns=True)
    order = Window.partitionBy("uk").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = sides.withColumn("n", F.last("n", ignorenulls=True).over(order)).where("probe = 1 AND n IS NOT NULL")
    return seen.select(F.col("at").alias("snap"), "uk", "n.vt", "n.val")


def seek(log: DataFrame, target, as_of: int | None = None) -> DataFrame:
    """The first live key that isn't smaller than ``target``."""
    return live(log.where(F.col("uk") >= F.lit(target)), as_of).orderBy("uk").limit(1)


def key_range(log: DataFrame, start=None, limit=None, as_of: int | None = None) -> DataFrame:
    """Live entries with start <= key < limit; null bounds are open."""
    if start is not None:
        log = log.where(F.col("uk") >= F.lit(start))
    if limit is not None:
        log = log.where(F.col("uk") < F.lit(limit))
    return live(log, as_of)


def first_n(log: DataFrame, n: int, as_of: int | None = None) -> DataFrame:
    return live(log, as_of).orderBy("uk").limit(n)


def history(log: DataFrame, n: int | None = None) -> DataFrame:
    """Versions of each key, newest first, the first ``n`` of each if given."""
    if n is None:
        return log.orderBy("uk", F.desc("seq"))
    order = Window.partitionBy("uk").orderBy(F.desc("seq"))
    return log.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def with_next(keys: DataFrame, segment: Column) -> DataFrame:
    """uk and next_uk, the key that follows; ``segment`` is non-decreasing in the key and cuts it into groups."""
    cut = keys.select("uk", segment.alias("__s"))
    heads = cut.groupBy("__s").agg(F.min("uk").alias("__m"))
    heads = heads.select("__s", F.lead("__m").over(Window.orderBy("__s")).alias("__m"))
    inside = F.lead("uk").over(Window.partitionBy("__s").orderBy("uk"))
    return cut.join(heads, "__s").select("uk", F.coalesce(inside, F.col("__m")).alias("next_uk"))


def with_position(keys: DataFrame, segment: Column, order: Column) -> DataFrame:
    """``keys`` with pos, the place from 1 in ``order``; ``segment`` is non-decreasing along it."""
    cut = keys.withColumn("__s", segment)
    counts = cut.groupBy("__s").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__s", F.coalesce(before, F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__s").orderBy(order))
    return cut.join(counts, "__s").withColumn("pos", (F.col("__b") + inside).cast("long")).drop("__s", "__b")


def merge_runs(*runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of each key over runs (with run_id), which may overlap; ``by``: for each of these columns' values."""
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    newest = both.groupBy(*by, "uk").agg(F.max_by(F.struct("seq", "run_id"), "seq").alias("n"))
    return newest.select(*by, "uk", "n.seq", "n.run_id")


def diff(log: DataFrame, old: int, new: int | None = None) -> DataFrame:
    """uk and what (added, removed, changed) between two snapshots."""
    before, after = live(log, old).withColumnRenamed("val", "v1"), live(log, new).withColumnRenamed("val", "v2")
    both = before.join(after, "uk", "full_outer")
    what = F.when(F.col("v1").isNull(), "added").when(F.col("v2").isNull(), "removed").when(F.col("v1") != F.col("v2"), "changed")
    return both.select("uk", what.alias("what")).where("what IS NOT NULL")


def is_sorted(rows: DataFrame, key: str, position: str, segment: Column) -> DataFrame:
    """ok: 1 if the keys don't decrease along ``position``."""
    cut = rows.withColumn("__s", segment)
    inside = F.lag(key).over(Window.partitionBy("__s").orderBy(position))
    steps = cut.select(F.when(inside.isNull() | (inside <= F.col(key)), 1).otherwise(0).alias("ok"))
    edges = cut.groupBy("__s").agg(F.min_by(key, position).alias("a"), F.max_by(key, position).alias("z"))
    before = F.lag("z").over(Window.orderBy("__s"))
    edges = edges.select(F.when(before.isNull() | (before <= F.col("a")), 1).otherwise(0).alias("ok"))
    return steps.union(edges).agg(F.min("ok").alias("ok"))
