"""Queries on event numbers that the tables of the small sizes don't reach."""

import pytest
from pyspark.sql import functions as F

from kvspark.functions import codec, keys
from kvspark.plans import catalogue

EVENTS = [0, 1, 199_999, 200_000, 240_960, 399_999, 599_999, 2_097_151, 2_097_152, 5_999_999, 36_000_000]


def wrapped(n):
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """The folder of a table of events with these numbers."""
    path = tmp_path_factory.mktemp("numbered")
    spark.createDataFrame([(n,) for n in EVENTS], "event_id long").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_wrapped_product(spark):
    some = [0, 1, -1, 7, 0xFFFF, 0x10000, 0xFFFFFFFF, 1 << 32, 46116860184273, -46116860184273, (1 << 63) - 1, -(1 << 63), 0x7FFF8000FFFF0001]
    rows = spark.createDataFrame([(a, b) for a in some for b in some] + [(None, 1)], "a long, b long")
    for a, b, got in rows.select("a", "b", keys.wrapped_product(F.col("a"), F.col("b"))).collect():
        assert got == (None if a is None else wrapped(a * b))


def test_varints_of_large_numbers(spark, numbered):
    got = {r["event_id"]: (r["varint"], r["value"]) for r in catalogue.queries()["i2_varint64"](spark, numbered).collect()}
    numbers = {e: wrapped(e * 46116860184273) for e in EVENTS}
    assert got == {e: (codec.varint(n).hex().upper(), n) for e, n in numbers.items()}


def test_little_endian_of_large_numbers(spark, numbered):
    got = {r["event_id"]: tuple(r[c] for c in ("four", "eight", "four_value", "eight_value")) for r in catalogue.queries()["i8_little_endian"](spark, numbered).collect()}
    numbers = {e: wrapped(e * 46116860184273) for e in EVENTS}
    low = {e: n & 0xFFFFFFFF for e, n in numbers.items()}
    assert got == {e: (low[e].to_bytes(4, "little").hex().upper(), (n % (1 << 64)).to_bytes(8, "little").hex().upper(), low[e], n) for e, n in numbers.items()}


def test_varint_sizes_of_large_numbers(spark, numbered):
    got = dict(map(tuple, catalogue.queries()["i4_varint_size"](spark, numbered).collect()))
    assert got == {e: len(codec.varint(-e - 1 if e % 7 == 0 else wrapped(e**3))) for e in EVENTS}


def test_checksums_of_large_numbers(spark, tmp_path):
    spark.createDataFrame([(4_000_000_000,), ((1 << 62) + 1,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["unmasked"] for r in catalogue.queries()["i10_crc_mask"](spark, str(tmp_path)).collect()}
    assert got == {e: e * 2654435761 & 0xFFFFFFFF for e in (4_000_000_000, (1 << 62) + 1)}


def test_padded_numbers_stay_whole(spark):
    numbers = [0, 7, 999_999, 1_000_000, 123_456_789_012, -5, (1 << 63) - 1, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", keys.test_key(F.col("n")).alias("k"), keys.padded(F.col("n"), 12).alias("p"))
    assert {tuple(r) for r in rows.collect()} == {(n, n if n is None else "key%06d" % n, n if n is None else "%012d" % n) for n in numbers}


@pytest.mark.parametrize("name", ["i21_test_key", "i13_prefix", "d16_block_seek"])
def test_long_numbers_same_as_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    numbers = [5, 999_999, 1_000_000, 5_999_999, 10**12 - 1, 10**12, 10**12 + 600, 10**12 + 700, 10**13 + 3]
    table = spark.createDataFrame([(n, n) for n in numbers], "event_id long, o_orderkey long")
    con = duckdb.connect()
    for view in ("events", "orders"):
        table.write.parquet(f"{tmp_path}/{view}.parquet")
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path}/{view}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(tmp_path))
    want = con.execute(catalogue.oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
