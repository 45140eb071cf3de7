"""Runs by the exact rule, in segments, against the fold of the whole log."""

import random

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from kvspark.operators import layout
from kvspark.plans import catalogue


def folded(rows, buffer):
    """{run: (n, lo, hi, bytes)} of (uk, seq, b); after an unknown size nothing is cut."""
    runs, used, run = {}, 0, 0
    for uk, _, b in sorted(rows, key=lambda r: r[1]):
        if used is not None and used > buffer:
            used, run = 0, run + 1
        used = None if used is None or b is None else used + b
        runs.setdefault(run, []).append((uk, b or 0))
    return {r: (len(of), min(u for u, _ in of), max(u for u, _ in of), sum(b for _, b in of)) for r, of in runs.items()}


def sizes_of(kind, rng, n):
    return {
        "mixed": lambda: [rng.choice([16, 16, 40, 90, 300]) for _ in range(n)],
        "same": lambda: [16] * n,
        "large": lambda: [rng.choice([1, 500, 5000]) for _ in range(n)],
        "zeros": lambda: [rng.choice([0, 0, 0, 60]) for _ in range(n)],
        "null": lambda: [None if i == n // 2 else 25 for i in range(n)],
    }[kind]()


@pytest.mark.parametrize("kind", ["mixed", "same", "large", "zeros", "null"])
@pytest.mark.parametrize(("buffer", "segment"), [(400, 64), (399, 64), (0, 16), (3000, 16), (10**9, 50)])
def test_segments_cut_as_the_whole_log(spark, kind, buffer, segment):
    rng = random.Random(f"{kind} {buffer}")
    logs = [[(rng.randrange(50), seq + 1, b) for seq, b in enumerate(sizes_of(kind, rng, n))] for n in (300, 77)]
    rows = [(shard, *r) for shard, log in enumerate(logs) for r in log]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "writer int, uk long, seq long, b long")
    got = {}
    for shard, run, *what in layout.exact_runs(frame, F.col("b"), buffer, F.col("writer"), segment).collect():
        got.setdefault(shard, {})[run] = tuple(what)
    assert got == {shard: folded(log, buffer) for shard, log in enumerate(logs)}


def test_no_function_gets_the_whole_log(spark, monkeypatch):
    n, most = 300_000, 1 << 18
    real = GroupedData.applyInPandas

    def bounded(self, fn, schema):
        def few(rows):
            assert len(rows) <= most
            return fn(rows)

        return real(self, few, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", bounded)
    log = spark.range(n).select((F.col("id") % 97).alias("uk"), (F.col("id") + 1).alias("seq"), (16 + F.col("id") % 5).alias("b"))
    got = {run: tuple(what) for _, run, *what in layout.exact_runs(log, F.col("b"), 4096).collect()}
    assert got == folded([(i % 97, i + 1, 16 + i % 5) for i in range(n)], 4096)


def test_g1_runs_exact_of_a_larger_table(spark, tmp_path):
    """More events than a segment holds: the query's runs are those of the whole log's fold."""
    n = 300_000
    table = spark.range(n).selectExpr("id AS event_id", "id % 97 AS user_id", "if(id % 11 = 0, 'error', 'click') AS event_type", "repeat('x', int(id % 7)) AS props")
    table.write.parquet(f"{tmp_path}/events.parquet")
    got = {run: tuple(what) for run, *what in catalogue.queries()["g1_runs_exact"](spark, str(tmp_path)).collect()}
    assert got == folded([(i % 97, i + 1, 16 + (0 if i % 11 == 0 else i % 7)) for i in range(n)], 4096)
