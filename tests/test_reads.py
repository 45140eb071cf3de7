"""Reads and compaction against a model that walks the log in order."""

import random

import pytest

from kvspark.operators import compact, log, read

SHAPE = "uk long, seq long, vt int, val string"


def random_log(seed, n=300, keys=25):
    rng = random.Random(seed)
    return [(rng.randrange(keys), s + 1, int(rng.random() < 0.7), f"v{s}") for s in range(n)]


def model(rows, as_of=10**9):
    state = {}
    for uk, seq, vt, val in sorted(rows, key=lambda r: r[1]):
        if seq <= as_of:
            state[uk] = (vt, val)
    return {uk: val for uk, (vt, val) in state.items() if vt}


@pytest.fixture(scope="module")
def rows():
    return random_log(301)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE).cache()


def as_dict(df):
    return {r["uk"]: r["val"] for r in df.collect()}


@pytest.mark.parametrize("s", [0, 1, 50, 299, 300])
def test_scan_as_of(table, rows, s):
    got = read.scan(table, s).collect()
    assert [(r["uk"], r["val"]) for r in got] == sorted(model(rows, s).items())


def test_seek_before_at_after_end(table, rows):
    live = sorted(model(rows).items())
    for uk, _ in live[::4]:
        for target in (uk - 1, uk, uk + 1):
            want = next(((k, v) for k, v in live if k >= target), None)
            row = read.seek(table, target).first()
            assert (row and (row["uk"], row["val"])) == want
    assert read.seek(table, 10**6).first() is None


def test_ranges(table, rows):
    for a, b in ((3, 9), (9, 3), (None, 5), (20, None)):
        want = {k: v for k, v in model(rows).items() if (a is None or k >= a) and (b is None or k < b)}
        assert as_dict(read.key_range(table, a, b)) == want


def test_reverse_next_position(spark, table, rows):
    from pyspark.sql import functions as F

    keys = sorted(model(rows))
    assert [r["uk"] for r in read.scan(table, descending=True).collect()] == keys[::-1]
    got = {r["uk"]: r["next_uk"] for r in read.with_next(read.live(table), F.expr("uk div 4")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None]))
    got = {r["uk"]: r["pos"] for r in read.with_position(read.live(table), F.expr("uk div 4"), F.col("uk")).collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_multi_get_and_asof_join(spark, table, rows):
    wanted = spark.createDataFrame([(k,) for k in range(30)], "uk long")
    got = {r["uk"]: (r["status"], r["val"]) for r in read.multi_get(table, wanted).collect()}
    live, seen = model(rows), {r[0] for r in rows}
    for k in range(30):
        assert got[k] == (("value", live[k]) if k in live else ("deleted", None) if k in seen else ("absent", None))
    probes = spark.createDataFrame([(k, s) for k in range(0, 30, 3) for s in (10, 150, 300)], "uk long, snap long")
    got = {(r["uk"], r["snap"]): r["val"] for r in read.asof_join(table, probes).where("vt = 1").collect()}
    assert got == {(k, s): model(rows, s)[k] for k in range(0, 30, 3) for s in (10, 150, 300) if k in model(rows, s)}


def test_diff(table, rows):
    a, b = model(rows, 100), model(rows)
    want = {k: "added" for k in b.keys() - a.keys()} | {k: "removed" for k in a.keys() - b.keys()}
    want |= {k: "changed" for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {r["uk"]: r["what"] for r in read.diff(table, 100).collect()} == want


@pytest.mark.parametrize("s", [0, 100, 300])
def test_compaction_keeps_every_later_view(table, rows, s):
    kept = [tuple(r) for r in compact.compact(table, s).collect()]
    for t in (s, (s + 300) // 2, 300):
        assert model(kept, t) == model(rows, t)
    again = compact.compact(compact.compact(table, s), s)
    assert sorted(map(tuple, again.collect())) == sorted(kept)


def test_history_of_one_key(spark):
    shape = "uk string, seq long, vt int, val string"
    foo = spark.createDataFrame([("foo", 1, 1, "v1"), ("foo", 2, 0, ""), ("foo", 3, 1, "v2")], shape)
    assert [r["val"] for r in read.history(foo).collect()] == ["v2", "", "v1"]
    assert [r["val"] for r in compact.compact(foo, 3).collect()] == ["v2"]
    gone = foo.where("seq < 3")
    deeper = spark.createDataFrame([("a", "z")], "lo string, hi string")
    assert [r["vt"] for r in compact.compact(gone, 3, deeper).collect()] == [0]  # a deeper file may hold foo
    assert compact.compact(gone, 3).count() == 0


def test_snapshots_hold_their_versions(table, rows):
    kept = [tuple(r) for r in compact.compact_for(table, [100, 200]).collect()]
    for s in (100, 200, 300):
        assert model(kept, s) == model(rows, s)


def test_sequences(spark, table):
    batch = spark.createDataFrame([(i,) for i in range(1, 40)], "op_ordinal int")
    got = {r["op_ordinal"]: r["seq"] for r in log.sequenced(batch, 7, "op_ordinal", 8).collect()}
    assert got == {i: 7 + i for i in range(1, 40)}
    with pytest.raises(ValueError):
        log.append(table, table)
