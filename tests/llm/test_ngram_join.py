import random

import numpy as np

from kvspark.llm import ngram_join
from kvspark.llm.ngram_join import jaccard_components, jaccard_links, keep_one


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def some_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 11, 40, 90]))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                if not text:
                    break
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], [rng.choice(words)], [text[at], rng.choice(words)]])
            if rng.random() < 0.3:
                text = [w.upper() for w in text]
            rows.append((rng.randrange(10_000), "\n ".join(text)))
    rows += [(5, None), (6, ""), (7, " \t"), (None, rows[0][1]), rows[0], (rows[0][0], rows[5][1]), (8, "É a b"), (9, "é a b")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, documents):
    for seed, k, num, den, limit in ((2, 3, 90, 100, 3), (4, 3, 7, 10, 4)):
        rows = some_rows(seed)
        got = sorted(map(tuple, jaccard_components(documents(rows), k, num, den, limit).collect()), key=str)
        assert got == brute(rows, k, num, den), seed


def test_empty(spark, documents):
    assert jaccard_components(documents([])).count() == 0


def test_one_stays(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(4, text), (2, text + " x"), (3, "other words"), (1, None), (None, text), (9, "")])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 9, None]


def test_levels_change_the_work_only(spark, documents, monkeypatch):
    rows = some_rows(5)
    want = brute(rows, 3, 8, 10)
    for step in (0,):  # without an order by frequency
        monkeypatch.setattr(ngram_join, "level_of", lambda counts, step=step: (np.log2(np.maximum(counts, 1)) * step).astype(np.uint8))
        got = sorted(map(tuple, jaccard_components(documents(rows), 3, 8, 10, 5).collect()), key=str)
        assert got == want


def test_counts_of_many_tasks(monkeypatch):
    rng = np.random.default_rng(1)
    total, parts = np.zeros(1 << 10, dtype=np.uint64), []
    for _ in range(5):
        counts = rng.integers(0, 3, 1 << 10).astype(np.uint32) * rng.integers(0, 2, 1 << 10).astype(np.uint32) * 70_000
        ngram_join.add_sparse(total, ngram_join.sparse(np.flatnonzero(counts), counts[counts > 0]))
        parts.append(counts)
    assert (total == np.sum(parts, axis=0)).all()


def test_copies_and_near_copies_over_many_partitions(spark, documents):
    """A group of exact copies, and one of more near copies than ``limit``, dealt over 60 partitions."""
    base = [f"w{i}" for i in range(60)]
    near = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join([*near[: i % 300], f"new{i}", *near[i % 300 + 1 :]])) for i in range(150)]
    rows += [(5000 + i, " ".join(f"u{i}.{j}" for j in range(30))) for i in range(50)]
    docs = documents(rows).repartition(60)
    want = {i: (0, 299) for i in range(300)} | {1000 + i: (1000, 149) for i in range(150)} | {5000 + i: (5000 + i, 0) for i in range(50)}
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_links(docs, limit=40).collect()}
    assert got == want
    kept = keep_one(docs, words=3, num=9, den=10, limit=40)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {0, 1000, *range(5000, 5050)}


def test_a_column_makes_fewer_pairs_than_rows():
    rng = np.random.default_rng(2)
    data = np.zeros(5000, dtype=ngram_join.PAIR)
    data["s"], data["id"], data["n"] = rng.integers(0, 3, 5000), rng.permutation(5000), rng.integers(10, 400, 5000)
    lead, pairs = ngram_join.same_size(ngram_join.in_order(data))
    assert len(pairs) + len(lead) == 5000 and len(ngram_join.neighbours(lead, 9, 10)) < len(lead)


def test_linked_sets(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ngram_join, "DENSE", 8)
    for num, den in ((9, 10), (8, 10), (5, 10)):
        base = rng.integers(0, 1000, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < r, rng.integers(0, 1000, 60), base).astype(np.uint64)[: rng.integers(1, 61)]) for r in rng.random(150) * 0.4]
        both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        size = np.array([len(s) for s in sets])
        want = den * both >= num * (size[:, None] + size - both)
        assert (ngram_join.linked(sets[:70], sets[70:], num, den) == want[:70, 70:]).all()
        assert (ngram_join.linked(sets, sets, num, den) == want).all()
        assert (ngram_join.linked(sets, None, num, den) == want).all()


def brute_links(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    found = []
    for i, (a, _) in enumerate(rows):
        n = 0
        for j, (b, _) in enumerate(rows):
            both = len(sets[i] & sets[j])
            n += i != j and b is not None and both > 0 and den * both >= num * (len(sets[i]) + len(sets[j]) - both)
        found.append((a, len(sets[i]), None if a is None else n))
    return sorted(found, key=str)


def test_all_links_are_counted(spark, documents):
    for seed, k, num, den, limit in ((1, 3, 90, 100, 2048), (3, 5, 8, 10, 2), (4, 3, 7, 10, 4)):
        rows = some_rows(seed)
        got = [tuple(r) for r in jaccard_links(documents(rows), k, num, den, limit).collect()]
        assert sorted(((a, n, links) for a, n, _, links in got), key=str) == brute_links(rows, k, num, den), seed
        assert sorted((r[:3] for r in got), key=str) == brute(rows, k, num, den), seed


def test_links_within_a_large_group(spark, documents):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(90)] + [(i, " ".join(words)) for i in (200, 201)]
    for limit in (20, 2048):
        got = [tuple(r) for r in jaccard_links(documents(rows), limit=limit).collect()]
        assert all(r[2:] == (0, 91) for r in got) and len(got) == 92


def test_repeated_and_nameless_rows_stay_once(spark, documents):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, text), (4, text), (4, "two words"), (None, text), (None, other), (None, other), (None, other + " x"), (None, None), (None, None), (7, ""), (7, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(documents(rows), nameless=True).collect()), key=str)
    assert [r for r in got if r[1] not in (other, other + " x")] == sorted([(4, text), (4, "two words"), (None, None), (None, None), (7, "")], key=str)
    assert len(got) == 6


def test_links_of_sets_alone_in_their_band(spark, documents):
    """Pairs of one size and the next: where a band ends between them, each set is alone in its own."""
    rows = []
    for n in range(20, 60):
        words = [f"w{n}.{i}" for i in range(n + 2)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join([*words, "more"])), (10 * n + 2, " ".join([*words, "more"]))]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_links(documents(rows)).collect()}
    assert got == {i: (i - i % 10, 2) for i, _ in rows}


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(6)
    for num, den in ((9, 10), (8, 10), (3, 4), (1, 1)):
        sets = []
        for size in [*range(1, 30), *rng.integers(30, 400, 60)]:
            base = rng.integers(0, 1 << 63, size).astype(np.uint64)
            for gone, new in ((0, 0), (den - num, 0), (0, den - num), (den - num, den - num)):
                left = base[int(size * gone * rng.random() / den) :]
                sets.append(np.unique(np.concatenate([left, rng.integers(0, 1 << 63, int(size * new * rng.random() / den)).astype(np.uint64)])))
        keys, counts = np.concatenate(sets), np.array([len(s) for s in sets])
        links = ngram_join.linked(sets, None, num, den)
        assert links.sum() > 1.2 * len(sets) or num == den
        for levels in (np.ones(1 << 10, dtype=np.uint8), rng.integers(1, 256, 1 << 10).astype(np.uint8)):
            signs, owner = ngram_join.parts_of(keys, counts, num, den, levels, ngram_join.weights_of(levels))
            own = [set(signs[owner == i].tolist()) for i in range(len(sets))]
            assert all(own[i] & own[j] for i, j in np.argwhere(links).tolist())


def test_blocks_stay_small_where_counters_tell_nothing(spark, documents):
    """Texts that by chance have many n-grams in common with others aren't brought together, near copies are."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(100, 200)))) for i in range(300)]
    rows += [(1000 + i, t + " new") for i, t in rows[:20]]
    for words, num in ((3, 90), (5, 80)):
        found = ngram_join._pairs(documents(rows).select("doc_id", "text"), words, num, 100, np.ones(1 << 18, dtype=np.uint8))
        pairs = {tuple(sorted(r)) for r in found.collect()}
        assert {(i, 1000 + i) for i in range(20)} <= pairs and len(pairs) < 30


def test_counters_are_summed_in_rounds(spark, documents, monkeypatch):
    """The levels of several rounds against counts of all n-grams."""
    monkeypatch.setattr(ngram_join, "FAN", 2)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = documents(list(enumerate(texts))).select("doc_id", "text").repartition(7)
    _, levels = ngram_join._counted(docs, 3)
    keys, _ = ngram_join.Sets(3).read([t.encode() for t in texts])
    total = np.bincount(ngram_join.counter_of(keys, len(levels).bit_length() - 1), minlength=len(levels))
    assert total.max() > 8
    assert levels.tolist() == np.where(total > 1, np.maximum(ngram_join.level_of(total), 1), 0).tolist()
