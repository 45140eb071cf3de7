"""Shared helpers: tables, the shared scratch folder, per-worker caches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kvspark.sources.scratch import discard  # noqa: F401
from kvspark.sources.scratch import settled as written  # noqa: F401  (cuts lineage by a table in the shared folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(docs: DataFrame) -> int:
    """About the bytes of the files that ``docs`` reads, by Spark's statistics; of the texts, if there are none."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else docs.selectExpr("sum(octet_length(text))").first()[0] or 0


def release() -> None:
    """Give freed memory back to the system: a reused worker else keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(fn):
    """``fn`` for ``applyInArrow``, with ``release`` after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        release()
        return out

    return run


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 22, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of the column, and of at most ``rows`` rows; a longer value is alone."""
    values = batch.column(column)
    size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    size = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(size, base + limit, side="right"))), at + rows)
        yield batch.slice(at, stop - at)
        at = min(stop, batch.num_rows)


def worker_cache(key: str, make, large: bool = False):
    """A value that a Python worker keeps over its tasks (functions are pickled
    by value, so their own globals live for one task only).

    Of ``large`` values, models and vocabularies, a worker keeps one: the next
    operator's takes the place of the one before.
    """
    held = sys.__dict__.setdefault("_kvspark_cache", {})
    if key not in held:
        if large:
            for other in held.pop("", ()):
                held.pop(other, None)
            held[""] = (key,)
        held[key] = make()
    return held[key]


def columns_as(df: DataFrame, **wanted: str) -> DataFrame:
    """Project ``df`` to the wanted columns (new name = old name), whatever else
    it carries; extra or clashing columns never reach the operator."""
    return df.select(*[df[old].alias(new) for new, old in wanted.items()])


def by_rows(fn: Callable[[pa.RecordBatch], list], names: list[str], types: list[pa.DataType], keep: tuple[str, ...] = (),
            rows: int = 512, weigh: str = "text", limit: int = 1 << 22) -> Callable:
    """A function for ``mapInArrow``: ``fn`` makes the columns ``names`` of at
    most ``rows`` input rows, and about ``limit`` bytes of the column ``weigh``, at a
    time; the columns ``keep`` pass unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, weigh, limit, rows):
                made = [pa.array(c, type=t) for c, t in zip(fn(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *made], names=[*keep, *names])
        release()

    return run


def kept_rows(fn: Callable[[pa.RecordBatch], list], rows: int = 512) -> Callable:
    """A function for ``mapInArrow`` that keeps the rows for which ``fn`` says True, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=rows):
                yield part.filter(pa.array(fn(part), type=pa.bool_()))
        release()

    return run
