"""Registered jobs over whole tables, whatever the size."""

import os

import pytest

from kvspark.operators import layout
from kvspark.plans import catalogue

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def runs(spark):
    """(uk, seq, vt, val, run_id) of all events."""
    rows = layout.with_runs(catalogue.events(spark, SF), catalogue.entry_size(), 8192)
    return [tuple(r) for r in rows.select("uk", "seq", "vt", "val", "run_id").collect()]


def inputs_of(pick, level, span):
    def meet(runs, at):
        lo, hi = min(span[r][0] for r in runs), max(span[r][1] for r in runs)
        return {r for r in span if r % 3 == at and at < 3 and span[r][0] <= hi and span[r][1] >= lo}

    inputs = meet({pick}, 0) if level == 0 else {pick}
    nexts = meet(inputs, level + 1)
    grown = meet(inputs | nexts, level)
    more = meet(grown, level + 1)
    return grown | more if nexts and len(grown) > len(inputs) and len(more) == len(nexts) else inputs | nexts


def test_table_source_reads_all_rows(spark):
    assert catalogue.queries()["a8_all_rows"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_flushed_is_all_but_the_last_run(spark, runs):
    last = max(r[4] for r in runs)
    newest = {uk: (vt, val) for uk, seq, vt, val, run in sorted(runs, key=lambda r: r[1]) if run < last}
    got = {tuple(r) for r in catalogue.queries()["d17_all_flushed"](spark, SF).collect()}
    assert got == {(uk, val) for uk, (vt, val) in newest.items() if vt == 1}


def test_every_pick_is_merged(spark, runs):
    every = {}
    for uk, seq, _, _, run in runs:
        every.setdefault(run, []).append((uk, seq))
    span = {run: (min(rows)[0], max(rows)[0]) for run, rows in every.items()}
    picks = {r["run_id"]: r["level"] for r in catalogue.queries()["g9_pick"](spark, SF).collect()}
    assert set(picks.values()) == {0, 1, 2}
    got, used = {}, set()
    for pick, uk, seq, run in catalogue.queries()["d12_every_pick"](spark, SF).collect():
        got.setdefault(pick, {})[uk] = (seq, run)
    assert got.keys() == picks.keys()
    for pick, level in picks.items():
        merged, newest = inputs_of(pick, level, span), {}
        for run in merged:
            for uk, seq in every[run]:
                newest[uk] = max(newest.get(uk, (0, 0)), (seq, run))
        assert got[pick] == newest
        used |= merged
    assert len(used) > len(every) // 2
