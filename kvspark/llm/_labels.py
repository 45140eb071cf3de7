"""Labelled rows for the classifiers, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import written

FOLDS = 5


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(FOLDS), F.lit(0))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text, label (int), check (boolean) of at most ``max_rows`` rows that aren't held out.

    The rows are the first by a hash of doc_id; ``check`` marks a fifth of them
    for calibration. Where a doc_id has several labels the largest counts. The
    chosen ids are few enough to be broadcast (``max_rows``).
    """
    ids = labels.where(~held_out(F.col("doc_id"))).where(F.col(label).isin(0, 1))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    check = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(FOLDS)) == 0
    few = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(few.join(F.broadcast(ids), "doc_id").select("text", "label", check.alias("check")), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) by Newton steps; with one class only, the bias gives its share."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 20.0 if len(y) and y.max() == 1 else -20.0
        return w
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - target) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))
