"""Toxicity by class-conditional Kneser-Ney models of the words' letters.

Two interpolated Kneser-Ney models of byte n-grams within words, one of toxic and
one of ordinary labelled texts, back off to one shared model whose continuation
counts come from all documents. A word's evidence is the difference of its two
log-likelihoods. Where neither class has seen a context, both models equal the
shared one and the evidence is nothing, so that rare words of ordinary texts
don't count. A document is judged by its length-normalised difference (per word)
and by its strongest expression; a logistic function of both, fitted on labelled
rows that the models haven't seen, gives the score.

Words are runs of letters (bytes a-z, A-Z lower-cased, and non-ASCII bytes).
Labels come from at most ``max_rows`` rows; the n-grams and contexts of the class
models, which bound all that is collected, come from those. The shared counts are
made of the n-grams of every document, distinct before they are shuffled.

Defined results: null and empty texts, and texts without words, have no evidence
(0 and 0); without labels of both classes all scores are about 0 (or 1, if all
are toxic); a null doc_id is held out; repeated rows are scored each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import by_rows, kept_rows, release, slices, worker_cache, written
from kvspark.llm._labels import fit_logistic, held_out, labelled_sample, logistic

ORDER, DISCOUNT, MAX_ROWS = 5, 0.75, 20_000
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: An n-gram of up to 7 bytes is a number: its length in the top byte, its bytes below.
LENGTH, BODY = 56, (1 << 56) - 1
#: Words and n-grams that a task remembers.
KEEP_WORDS, KEEP_GRAMS = 200_000, 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte after a word's start mark the n-gram of it and up to order - 1 bytes before it, and its word."""
    raw = np.frombuffer(b"^" + b"$^".join(words) + b"$", dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = raw.copy()
    for back in range(1, order):
        body[back:] |= raw[:-back] << (8 * back)
    size = np.minimum(place + 1, order)
    inner = place > 0
    return ((size << LENGTH) | (body & ((1 << 8 * size) - 1)))[inner], np.repeat(np.arange(len(words)), sizes)[inner]


def context_of(gram: np.ndarray) -> np.ndarray:
    """Without the last byte."""
    return (((gram >> LENGTH) - 1) << LENGTH) | ((gram & BODY) >> 8)


def back_of(gram: np.ndarray) -> np.ndarray:
    """Without the first byte."""
    size = (gram >> LENGTH) - 1
    return (size << LENGTH) | (gram & ((1 << 8 * size) - 1))


class Table:
    """Numbers by n-gram; ``rest`` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray, rest: float | np.ndarray = 0.0) -> np.ndarray:
        if len(self.keys) == 0:
            return np.broadcast_to(np.asarray(rest, dtype=np.float64), keys.shape)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], rest)


class Counts:
    """Counts by n-gram, with totals and types by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, Table(keys, counts)
        self.contexts, whose = np.unique(context_of(keys), return_inverse=True)
        self.totals = Table(self.contexts, np.bincount(whose, weights=counts, minlength=len(self.contexts)))
        self.types = Table(self.contexts, np.bincount(whose, minlength=len(self.contexts)))

    def left(self, context: np.ndarray) -> np.ndarray:
        """The share that a context leaves to the shorter one: all, if it was never seen."""
        total = self.totals.get(context)
        return np.where(total > 0, DISCOUNT * self.types.get(context) / np.maximum(total, 1), 1.0)

    def own(self, gram: np.ndarray) -> np.ndarray:
        """The discounted share of its context."""
        total = self.totals.get(context_of(gram))
        return np.where(total > 0, np.maximum(self.counts.get(gram) - DISCOUNT, 0) / np.maximum(total, 1), 0.0)

    def p(self, gram: np.ndarray) -> np.ndarray:
        """Interpolated probabilities; the empty n-gram is one byte of 256."""
        out = np.full(len(gram), 1 / 256)
        some = np.flatnonzero(gram >> LENGTH > 0)
        if len(some):
            lower, at = np.unique(back_of(gram[some]), return_inverse=True)
            out[some] = self.own(gram[some]) + self.left(context_of(gram[some])) * self.p(lower)[at]
        return out


def evidence(classes: list[Counts], shared: Counts) -> tuple[Table, Table]:
    """Log-likelihood differences of the n-grams that a class has seen, and of others by context."""
    contexts = np.union1d(classes[0].contexts, classes[1].contexts)
    gram = np.union1d(classes[0].keys, classes[1].keys)
    lower, at = np.unique(back_of(gram), return_inverse=True)
    back = shared.p(lower)[at]
    p = [c.own(gram) + c.left(context_of(gram)) * back for c in classes]
    others = np.log(classes[1].left(contexts) / classes[0].left(contexts))
    return Table(gram, np.log(p[1] / p[0])), Table(contexts, others)


class Model:
    def __init__(self, seen: Table, contexts: Table, order: int, keep: int = KEEP_WORDS) -> None:
        self.seen, self.contexts, self.order, self.keep = seen, contexts, order, keep
        self.words: dict[bytes, float] = {}
        self.weights = np.zeros(3)

    def told(self, words: list[bytes]) -> np.ndarray:
        """The evidence of each word."""
        gram, whose = grams(words, self.order)
        value = self.seen.get(gram, self.contexts.get(context_of(gram)))
        return np.bincount(whose, weights=value, minlength=len(words))

    def stats(self, texts: list[str | None]) -> np.ndarray:
        """Mean and largest evidence of each text's words."""
        out, split = np.zeros((len(texts), 2)), [words_of(t) for t in texts]
        fresh = set().union(*split)
        if len(self.words) > self.keep:
            self.words.clear()
        new = list(fresh - self.words.keys())
        if new:
            self.words.update(zip(new, self.told(new).tolist(), strict=True))
        value = self.words.__getitem__
        for i, words in enumerate(split):
            if words:
                got = list(map(value, words))
                out[i] = sum(got) / len(got), max(got)
        for word in new:
            if len(word) > 64:
                del self.words[word]
        return np.clip(out, -50, 50)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}}


def _count(sample: DataFrame, order: int) -> list[Counts]:
    """n-gram counts of both classes; a word counts once for each text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held[label].update(set(words_of(text)))
        for c in (0, 1):
            gram, whose = grams(list(held[c]), order) if held[c] else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
            found, at = np.unique(gram, return_inverse=True)
            times = np.bincount(at, weights=np.array(list(held[c].values()))[whose], minlength=len(found)) if len(found) else found
            columns = [pa.array(found), pa.array(np.full(len(found), c, dtype=np.int32)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "label", "n"])

    rows = sample.where("not check").select("text", "label").mapInArrow(run, "gram long, label int, n long")
    got = rows.groupBy("gram", "label").agg(F.sum("n").alias("n")).toArrow()  # of the labelled sample
    gram, label, n = (got.column(c).to_numpy() for c in ("gram", "label", "n"))
    return [Counts(gram[label == c], n[label == c].astype(np.float64)) for c in (0, 1)]


def _shared(docs: DataFrame, order: int, wanted: np.ndarray) -> Counts:
    """Continuation counts over all documents, of the contexts that the class models can ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, words = np.empty(0, dtype=np.int64), set()
        for batch in (part for whole in batches for part in slices(whole, limit=1 << 23)):
            fresh: set[bytes] = set()
            for text in batch.column("text").to_pylist():
                fresh.update(words_of(text))
            fresh -= words
            if not fresh:
                continue
            found = np.setdiff1d(grams(list(fresh), order)[0], told)
            told = np.union1d(told, found)
            words |= fresh
            if len(words) > KEEP_WORDS:
                words = set()
            if len(told) > KEEP_GRAMS:
                told = told[:0]
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["gram"])
        del told, words
        release()

    top = written(docs.select("text").mapInArrow(run, "gram long").distinct(), "grams")
    asked = docs.sparkSession.createDataFrame(pa.table({"context": pa.array(wanted)}))
    size = f"(shiftright(gram, {LENGTH}) - 1)"
    back = f"shiftleft({size}, {LENGTH}) | (gram & (shiftleft(1L, cast(8 * {size} AS int)) - 1))"
    context = f"shiftleft({size}, {LENGTH}) | shiftright(gram & {BODY}L, 8)"
    # the n-grams of a length are those of the next one without their first byte, counted by
    # those first bytes, and the ones that start a word
    level, both = top.where(f"shiftright(gram, {LENGTH}) = {order}"), None
    for k in range(order - 1, 0, -1):
        level = level.selectExpr(f"{back} AS gram").groupBy("gram").agg(F.count("*").alias("n"))
        part = level.withColumn("context", F.expr(context)).join(F.broadcast(asked), "context")  # asked: of the labelled sample
        both = part.select("gram", "n") if both is None else both.union(part.select("gram", "n"))
        level = level.select("gram").union(top.where(f"shiftright(gram, {LENGTH}) = {k}"))
    got = both.toArrow()
    return Counts(got.column("gram").to_numpy(), got.column("n").to_numpy().astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, order: int = ORDER) -> Model:
    """The class models from labelled rows that aren't held out, the shared one from all of ``docs``."""
    sample = labelled_sample(docs, labels, "toxic", max_rows)
    classes = _count(sample, order)
    wanted = [np.union1d(classes[0].contexts, classes[1].contexts)]
    while len(wanted[-1]) and (wanted[-1] >> LENGTH).max() > 0:  # each context's shorter ones, down to the empty one
        some = wanted[-1]
        wanted.append(np.unique(back_of(some[some >> LENGTH > 0])))
    model = Model(*evidence(classes, _shared(docs, order, np.unique(np.concatenate(wanted)))), order)

    def make(batch: pa.RecordBatch) -> list:
        stats = model.stats(batch.column("text").to_pylist())
        return [stats[:, 0], stats[:, 1]]

    few = sample.where("check").select("text", "label")
    rows = few.mapInArrow(by_rows(make, ["mean", "most"], [pa.float64()] * 2, ("label",)), "label int, mean double, most double")
    got = rows.toPandas()
    model.weights = fit_logistic(got[["mean", "most"]].to_numpy(), got["label"].to_numpy())
    return model


def _scorer(docs: DataFrame, model: Model):
    context = docs.sparkSession.sparkContext
    held = context.broadcast(model)  # bounded by the labelled sample
    name = f"toxicity:{context.applicationId}:{held._jbroadcast.id()}"

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        own = worker_cache(name, lambda: held.value, large=True)
        return logistic(own.stats(batch.column("text").to_pylist()), own.weights)

    return scores


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scores = _scorer(docs, train(docs, labels, max_rows))
    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    run = by_rows(lambda batch: [scores(batch)], ["score"], [pa.float64()], ("doc_id",))
    found = few.mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= cut).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more, all columns unchanged."""
    scores = _scorer(docs, train(docs, labels, max_rows))
    return docs.mapInArrow(kept_rows(lambda batch: scores(batch) < cut), docs.schema)
