import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kvspark.llm import quality, toxicity
from kvspark.llm._labels import fit_logistic, logistic

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(seed=1, n=700):
    """Texts of syllables; toxic ones hold a word of four stems, low-quality ones end in signs."""
    rng = random.Random(seed)
    syllables = ["an", "the", "er", "ing", "on", "ble", "sh", "ou", "re", "st"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 120))]
        toxic, low = int(rng.random() < 0.25), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumlo", "vexxa", "Zorqi", "plimf"]) + rng.choice(["", "er", "ing"]))
        if low:
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - low, toxic, "clash"))
    return docs, labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, documents, kind):
    docs, labels = corpus()
    extra = [(5000, None), (5001, ""), (None, "an the er"), (3, docs[3][1])]
    call = quality.quality_scores if kind == "quality" else toxicity.toxicity_scores
    got = call(documents(docs + extra), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + 4
    truth = {i: (q if kind == "quality" else t) for i, q, t, _ in labels}
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.3 if kind == "quality" else 0.5))
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert total > 100 and right >= 0.95 * total


def test_filters_keep_columns(spark, documents):
    docs, labels = corpus()
    frame, told = documents(docs + [(None, "an the"), (9000, None)]), spark.createDataFrame(labels, LABELS)
    for call, column, bad in ((toxicity.drop_toxic, 2, 1), (quality.drop_low_quality, 1, 0)):
        kept = call(frame, told)
        assert kept.schema == frame.schema
        ids = {r["doc_id"] for r in kept.collect()}
        wrong = sum((label[column] == bad) == (label[0] in ids) for label in labels)
        assert wrong <= 0.04 * len(labels)


@pytest.mark.parametrize("call", [quality.quality_scores, toxicity.toxicity_scores])
def test_no_labels_and_no_rows(spark, documents, call):
    none = spark.createDataFrame([], LABELS)
    got = call(documents([(1, "some words"), (2, None)]), none).collect()
    assert len(got) == 2 and all(r["score"] < 0.01 for r in got)
    assert call(documents([]), none).count() == 0


def test_shared_counts_are_kneser_ney(spark, documents):
    """The shared model against one by definition, over all documents."""
    docs = [(1, "abc abd"), (2, "bca ab"), (3, None), (4, "ab")]
    grams = {g for _, t in docs for w in toxicity.words_of(t) for g in plain_grams(w, 3)}
    asked = {g[i:-1] for g in grams for i in range(len(g))}
    shared = toxicity._shared(documents(docs).select("text"), 3, np.array(sorted(map(number, asked))))

    level, seen = {g for g in grams if len(g) == 3}, {}
    for k in (2, 1):
        for g in level:
            seen.setdefault(g[1:], set()).add(g[0])
        level = {g[1:] for g in level} | {g for g in grams if len(g) == k}

    def by_definition(gram):
        if not gram:
            return 1 / 256
        same = {g: len(x) for g, x in seen.items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        total, lower = sum(same.values()), by_definition(gram[1:])
        if not total:
            return lower
        return max(same.get(gram, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(same) / total * lower

    for gram in (b"bc", b"ab", b"ca", b"b$", b"a", b"zz"):
        assert shared.p(np.array([number(gram)]))[0] == pytest.approx(by_definition(gram))


def plain_grams(word, order):
    marked = b"^" + word + b"$"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def number(gram):
    return len(gram) << toxicity.LENGTH | int.from_bytes(gram, "big")


def test_grams_as_numbers():
    words = [b"a", b"telephone", "größe".encode(), b"x" * 80]
    gram, whose = toxicity.grams(words, 5)
    want = [(number(g), i) for i, w in enumerate(words) for g in plain_grams(w, 5)]
    assert list(zip(gram.tolist(), whose.tolist())) == want
    some = np.array([number(b"abcde"), number(b"a")])
    assert toxicity.context_of(some).tolist() == [number(b"abcd"), number(b"")]
    assert toxicity.back_of(some).tolist() == [number(b"bcde"), number(b"")]


def test_evidence_is_the_difference_of_two_models():
    """The class models and the words' evidence against models by definition."""
    texts = ([b"good", b"goal", b"mood"], [b"bad", b"bald", b"mad", b"good"])
    alphabet = {g for words in texts for w in words for g in plain_grams(w, 3)}
    shared_counts = {g[1:]: 2 for g in alphabet if len(g) > 1} | {g[2:]: 3 for g in alphabet if len(g) > 2}
    counts = [{}, {}]
    for c, words in enumerate(texts):
        for w in words:
            for g in plain_grams(w, 3):
                counts[c][g] = counts[c].get(g, 0) + 1

    def interpolated(table, gram, lower):
        same = {g: n for g, n in table.items() if g[:-1] == gram[:-1] and len(g) == len(gram)}
        total = sum(same.values())
        if not total:
            return lower
        return max(same.get(gram, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(same) / total * lower

    def shared_p(gram):
        return interpolated(shared_counts, gram, shared_p(gram[1:])) if gram else 1 / 256

    made = lambda table: toxicity.Counts(np.array(list(map(number, table)), dtype=np.int64), np.array(list(table.values()), dtype=float))
    model = toxicity.Model(*toxicity.evidence([made(c) for c in counts], made(shared_counts)), 3)
    words = [b"good", b"bad", b"mood", b"zebra", b"gold"]
    want = [sum(np.log(interpolated(counts[1], g, shared_p(g[1:])) / interpolated(counts[0], g, shared_p(g[1:]))) for g in plain_grams(w, 3)) for w in words]
    assert model.told(words) == pytest.approx(want)


def test_dual_descent_reaches_the_optimum():
    """Against projected gradient on the dual of a small problem."""
    rng = np.random.default_rng(1)
    n = 40
    columns = [np.sort(rng.choice(12, size=rng.integers(1, 6), replace=False)) for _ in range(n)]
    values = [rng.normal(size=len(c)) for c in columns]
    y = rng.integers(0, 2, n)
    w = quality.dual_descent(np.concatenate(columns), np.concatenate(values), np.cumsum([len(c) for c in columns]), y, np.full(n, 0.5), 3000)
    dense = np.zeros((n, 13))
    for i, (c, v) in enumerate(zip(columns, values)):
        dense[i, c], dense[i, 12] = v, 1
    sign = np.where(y == 1, 1.0, -1.0)
    gram = (dense @ dense.T) * np.outer(sign, sign)
    alpha = np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - 0.02 * (gram @ alpha - 1), 0, 0.5)
    best = dense.T @ (alpha * sign)
    mine = np.append(w[:12], w[-1])
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - sign * (dense @ v)).sum()
    assert loss(mine) <= loss(best) * 1.005


def test_logistic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = fit_logistic(x, np.array([0, 0, 1, 1]))
    p = logistic(x, w)
    assert (p[:2] < 0.5).all() and (p[2:] > 0.5).all()


def test_the_shared_counts_take_a_batch_in_slices(monkeypatch):
    """A batch of long texts isn't turned into n-grams at once."""
    held = []

    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            words = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(1_000_000, 1_400_000)]
            texts = [(" ".join(words[k::20]) + " ") * 8 for k in range(20)]
            found = [x for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])) for x in b.column(0).to_pylist()]
            assert len(found) == len(set(found)) and set(found) == set(toxicity.grams(sorted({w for t in texts for w in toxicity.words_of(t)}), 3)[0].tolist())
            raise KeyError

    grams = toxicity.grams
    monkeypatch.setattr(toxicity, "grams", lambda words, order: held.append(len(words)) or grams(words, order))
    with pytest.raises(KeyError):
        toxicity._shared(Documents(), 3, np.empty(0, dtype=np.int64))
    assert sum(held[:-1]) == 400_000 and max(held[:-1]) < 250_000
