"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of the text's outline (letters and digits
folded to classes, runs of one class collapsed, so that punctuation, case and
layout remain), of words repeated in a row, and of single words, hashed into
``SIZE`` columns. Each indicator is scaled by the log ratio of its smoothed
frequencies in the two classes, rows are normalised, and a linear model with
hinge loss is fitted by dual coordinate descent, both classes weighing alike.
A logistic function of the margin, fitted on labelled rows that the model hasn't
seen, gives the score.

Labels come from at most ``max_rows`` rows; only these rows' features reach the
driver.

Defined results: null and empty texts have no features and get the score of the
bias; without labels of both classes all scores are about 0 or 1, as the labels
are; a null doc_id is held out; repeated rows are scored each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import by_rows, kept_rows, worker_cache
from kvspark.llm._labels import fit_logistic, held_out, labelled_sample, logistic
from kvspark.llm._words import U64, Hasher, chunks, mix, positions

BITS, MAX_ROWS = 18, 16_000
SIZE = 1 << BITS
#: Classes of bytes: lower-case and non-ASCII letters 1, capitals 2, digits 3, others as they are.
FOLD = np.array(
    [1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 0 if b == 0 else b if b > 3 else 4
     for b in range(256)], dtype=np.uint64)


def column(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values + U64(kind << 56)) >> U64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct columns text after text, number of each text)."""
    hasher = worker_cache("hasher", Hasher)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    fold = FOLD[raw]
    keep = np.concatenate([[True], (fold[1:] != fold[:-1]) | (fold[1:] == 0)])
    at = np.flatnonzero(keep)
    fold, owner = fold[at], np.searchsorted(ends, at, side="right")
    whose, columns = [], []
    for n in (1, 2, 3, 4, 5):
        m = len(fold) - n + 1
        if m <= 0:
            continue
        code, inside = np.zeros(m, dtype=U64), np.ones(m, dtype=bool)
        for i in range(n):
            code = (code << U64(8)) | fold[i : i + m]
            inside &= fold[i : i + m] != 0
        whose.append(owner[:m][inside])
        columns.append(column(code[inside], n))
    words, counts = hasher.words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    place, _ = positions(counts)
    same = np.zeros(len(words), dtype=np.int64)  # how many equal words stand just before, up to 3
    for k in (1, 2, 3):
        same[k:] += (words[k:] == words[:-k]) & (same[k:] == k - 1) & (place[k:] >= k)
    again = same > 0
    whose += [owner, owner[again]]
    columns += [column(words, 8), column(same[again].astype(U64), 9)]
    key = np.unique(np.concatenate(whose) * SIZE + np.concatenate(columns))
    return key % SIZE, np.bincount(key // SIZE, minlength=len(texts))


def count_ratios(x: np.ndarray, counts: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of each column's smoothed frequency in class 1 and class 0."""
    label = np.repeat(y, counts)
    both = [np.bincount(x[label == c], minlength=SIZE) + alpha for c in (0, 1)]
    rows = [float((y == c).sum()) + 2 * alpha for c in (0, 1)]
    return np.log(both[1] / rows[1]) - np.log(both[0] / rows[0])


def dual_descent(x: np.ndarray, value: np.ndarray, stops: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int) -> np.ndarray:
    """min w.w/2 + sum cost * hinge, by coordinates of the dual (the last column is the bias)."""
    w = np.zeros(SIZE + 1)
    sign = np.where(y == 1, 1.0, -1.0)
    cuts = [0, *stops.tolist()]
    rows = [(x[i:j], value[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]  # views
    norm = [float(v @ v) + 1 for _, v in rows]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            index, v = rows[i]
            slope = sign[i] * (float(w[index] @ v) + w[SIZE]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[index] += step * sign[i] * v
                w[SIZE] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def scaled(x: np.ndarray, counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Each row's ratios, divided by the row's length."""
    value = ratio[x]
    size = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=value * value, minlength=len(counts))
    return value / np.repeat(np.sqrt(np.maximum(size, 1e-12)), counts)


def margins(texts: list[bytes], ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), float(w[-1]))
    for a, b in chunks(texts, 1 << 19):
        x, counts = features(texts[a:b])
        value = scaled(x, counts, ratio) * w[x]
        out[a:b] += np.bincount(np.repeat(np.arange(b - a), counts), weights=value, minlength=b - a)
    return out


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


class Model:
    def __init__(self, ratio: np.ndarray, w: np.ndarray) -> None:
        self.ratio, self.w, self.weights = ratio, w, np.zeros(2)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return logistic(margins(texts, self.ratio, self.w)[:, None], self.weights)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cost: float = 1.0, rounds: int = 12) -> Model:
    sample = labelled_sample(docs, labels, "quality", max_rows)

    def make(batch: pa.RecordBatch) -> list:
        texts, found = raw_texts(batch), []
        for a, b in chunks(texts, 1 << 19):
            x, counts = features(texts[a:b])
            stops = np.cumsum(counts).tolist()
            found += [x[j - c : j].astype("<i4").tobytes() for j, c in zip(stops, counts.tolist(), strict=True)]
        return [found]

    rows = sample.mapInArrow(by_rows(make, ["x"], [pa.binary()], ("label", "check")), "label int, check boolean, x binary")
    got = rows.toArrow()  # max_rows rows of packed columns
    y, check = got.column("label").to_numpy(), got.column("check").to_numpy()
    blobs = got.column("x").to_pylist()
    fit = np.flatnonzero(~check.astype(bool))
    counts = np.array([len(blobs[i]) // 4 for i in fit], dtype=np.int64)
    x = np.frombuffer(b"".join(blobs[i] for i in fit), dtype="<i4").astype(np.int64)
    if len(fit) == 0 or y[fit].min() == y[fit].max():
        model = Model(np.zeros(SIZE), np.zeros(SIZE + 1))
        model.weights = fit_logistic(np.zeros((len(y), 1)), y)
        return model
    ratio = count_ratios(x, counts, y[fit])
    share = np.array([max(1, (y[fit] == c).sum()) for c in (0, 1)]) / len(fit)
    w = dual_descent(x, scaled(x, counts, ratio), np.cumsum(counts), y[fit], cost * 0.5 / share[y[fit]], rounds)
    model = Model(ratio, w)
    rest = np.flatnonzero(check.astype(bool))
    if len(rest) and y[rest].min() != y[rest].max():
        own = rest
    else:  # too few rows to keep some apart
        own = fit
    margin = np.empty(len(own))
    for k, i in enumerate(own.tolist()):
        xi = np.frombuffer(blobs[i], dtype="<i4").astype(np.int64)
        margin[k] = scaled(xi, np.array([len(xi)]), ratio) @ w[xi] + w[-1]
    model.weights = fit_logistic(margin[:, None], y[own])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))  # SIZE numbers, twice
    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    run = by_rows(lambda batch: [held.value.score(raw_texts(batch))], ["score"], [pa.float64()], ("doc_id",))
    found = few.mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= cut).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def drop_low_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without the rows that score under ``cut``, all columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    return docs.mapInArrow(kept_rows(lambda batch: held.value.score(raw_texts(batch)) >= cut), docs.schema)
