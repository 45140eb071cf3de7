import hashlib
import random

from kvspark.llm.substring import drop_repeats, repeat_digest


def brute(rows, window):
    """By definition: the earliest start of each window, in order of doc_id (of rows with one id: of their text)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, rows[k][1] or ""))
    seen, out = set(), []
    for k in order:
        words = (rows[k][1] or "").encode().split()
        drop = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                drop[s : s + window] = [True] * window
            seen.add(w)
        kept = [w for w, d in zip(words, drop) if not d]
        out.append((rows[k][0], len(words), sum(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            at = rng.randint(0, len(text))
            text[at:at] = p[a:]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (7, None), (None, rows[1][1]), (8, ""), (9, "a " * 100), (10, "é " * 45 + "x\x85y")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, documents):
    for seed, window in ((1, 20), (2, 20), (3, 9), (4, 4)):
        rows = some_rows(seed)
        got = sorted(map(tuple, repeat_digest(documents(rows), window, blocks=5).collect()), key=str)
        assert got == brute(rows, window)


def test_empty(spark, documents):
    assert repeat_digest(documents([])).count() == 0


def test_texts_keep_their_columns(spark, documents):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = documents([(1, "a  b\n" + passage), (2, "c " + passage + " d"), (3, None), (4, "x  y")])
    made = drop_repeats(docs.withColumn("__block", docs["n_chars"] + 1))
    assert made.columns == [*docs.columns, "__block"]
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[4]["__block"] == 5
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["a  b\n" + passage, "c d", None, "x  y"]
    assert got[2]["n_chars"] == 3 and got[2]["block"] == "x" and got[3]["n_chars"] is None
