"""The mutation log: uk (key), seq (long), vt (1 put, 0 delete), val."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LEVEL_FILES = 4


@dataclass(frozen=True)
class Snapshot:
    """A sequence number and the version of the store that it was taken of."""

    version: int
    seq: int


def running_total(df: DataFrame, order: Column, value: Column, name: str, segment: Column) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with the row.

    ``segment`` is a non-decreasing function of ``order`` that cuts the rows into
    groups of bounded size: the sum of all earlier segments comes from a table with
    a row for each segment, so that no window holds all rows.
    """
    cut = df.withColumns({"__s": segment, "__v": value, "__o": order})
    whole = cut.groupBy("__s").agg(F.sum("__v").alias("__t"))
    before = F.sum("__t").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select("__s", F.coalesce(before, F.lit(0)).alias("__b"))
    inside = F.sum("__v").over(Window.partitionBy("__s").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0))
    out = cut.join(whole, "__s").withColumn(name, (F.col("__b") + inside).cast("long"))
    return out.drop("__s", "__v", "__o", "__b")


def sequenced(batch: DataFrame, base: int, ordinal: str, segment_size: int = 1 << 20) -> DataFrame:
    """Contiguous sequence numbers after ``base``, in order of ``ordinal`` (an integer column)."""
    segment = F.expr(f"{ordinal} div {segment_size}")
    return running_total(batch, F.col(ordinal), F.lit(1), "__n", segment).withColumn("seq", F.col("__n") + base).drop("__n")


def batch_bytes(key: Column, value: Column, vt: Column) -> Column:
    """Estimated size of a batch's operation: 12 and both lengths for a put, 6 and the key's for a delete."""
    return F.when(vt == 1, F.octet_length(key) + F.octet_length(value) + 12).otherwise(F.octet_length(key) + 6)


def entry_bytes(key_bytes: Column, val: Column) -> Column:
    """Memory of an entry: key, packed sequence number, value."""
    return key_bytes + F.lit(8) + F.octet_length(val)


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows; sequence numbers must be larger than all before."""
    top = log.agg(F.max("seq")).first()[0]
    low = new.agg(F.min("seq")).first()[0]
    if top is not None and low is not None and low <= top:
        raise ValueError(f"sequence {low} is not after {top}")
    return log.unionByName(new)
