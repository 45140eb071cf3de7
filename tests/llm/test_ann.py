import numpy as np

from kvspark.llm.ann import nearest

SHAPE = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = (x * q).sum(axis=1)
            out[i] = [int(j) for j in ids[np.lexsort((ids, -score))] if j != i][:k]
    return out


def results(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SHAPE)
    got, want = results(nearest(frame, per_shard=800)), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 20 * len(want)


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(6)
    hot = [1.0, 2.0, 0.0, -1.0]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    bad = [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [float("nan")] * 4), (1080, [1.0, float("inf"), 0.0, 0.0]), (1101, [1.0]), (None, hot), (3, hot)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows + bad], SHAPE)
    assert results(nearest(frame, per_shard=50)) == brute(rows, 20, 20)


def test_few_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.5, 1.0], 0, ""), (2, [2.0, 0.0], 0, "")], SHAPE)
    assert results(nearest(frame)) == {0: [2, 1]}
    assert nearest(frame.limit(0)).count() == 0


def test_recall_beside_vectors_of_large_norm(spark):
    for large in (1e4, 1e25):
        rng = np.random.default_rng(7)
        x = rng.normal(size=(2000, 16)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[[3, 777, 1501]] *= np.float32(large)
        frame = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], SHAPE)
        got, want = results(nearest(frame, per_shard=1000)), brute(list(enumerate(x)), 20, 20)
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert hits >= 0.95 * 20 * len(want), (large, hits / 20 / len(want))


def exact(rows, every, k):
    """Brute force on vectors that a power of two brings into range."""
    x = np.array([v for _, v in rows], dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
    return brute_doubles([i for i, _ in rows], x, every, k)


def brute_doubles(ids, x, every, k):
    ids, out = np.array(ids), {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = (x * (q / np.abs(q).max())).sum(axis=1)
            out[int(i)] = [int(j) for j in ids[np.lexsort((ids, -score))] if j != i][:k]
    return out


def test_no_query_is_lost_at_any_scale(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 8))
    mixed = base * np.where(np.arange(400) % 3 == 0, 1e-25, 1.0)[:, None]
    cases = [(base * 1e25, "float"), (mixed, "float"), (base * 1e200, "double"), (base * 1e-200, "double")]
    for x, kind in cases:
        x = x.astype(np.float32).astype(np.float64) if kind == "float" else x
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SHAPE.replace("float", kind))
        got, want = results(nearest(frame, per_shard=150)), exact(rows, 20, 20)
        assert got.keys() == want.keys()
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert hits >= 0.9 * 20 * len(want), (kind, float(np.abs(x).max()), hits / 20 / len(want))


def test_scores_of_doubles_and_of_other_lengths(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 3)))]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SHAPE.replace("float", "double"))
    made = nearest(frame, per_shard=50)
    values = dict(rows)
    for r in made.collect():
        a, b = np.array(values[r["query_id"]]), np.array(values[r["vec_id"]])
        assert r["score"] == (a * b).sum()
    want = brute_doubles(range(120), x, 20, 20) | brute_doubles([i for i, _ in rows[120:]], np.array([v for _, v in rows[120:]]), 20, 20)
    assert results(made) == want
