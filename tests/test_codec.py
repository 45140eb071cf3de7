import random

import pytest
from pyspark.sql import functions as F

from kvspark.functions import codec, keys


def test_crc32c_vectors():
    table = codec.crc_table()
    values = [bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1)), b""]
    assert codec.crc32c_many(values, table).tolist() == [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0x113FDB5C, 0]


def test_crc_column(spark):
    rows = spark.createDataFrame([(bytearray(32),), (None,)], "b binary")
    got = rows.select(codec.crc32c("b").alias("c"), keys.crc_unmask(codec.masked_crc32c(F.col("b"))).alias("u")).collect()
    assert [tuple(r) for r in got] == [(0x8A9136AA, 0x8A9136AA), (None, None)]


@pytest.mark.parametrize("bits", [32, 64])
def test_varints(bits):
    values = [0, 1, 127, 128, 16383, 16384, (1 << (bits - 1)) - 1, -1, -5]
    for v in values:
        data = codec.varint(v, bits)
        assert codec.read_varint(data, 0, bits) == (v, len(data))
    with pytest.raises(ValueError):
        codec.read_varint(b"\xff" * 11, 0, bits)
    with pytest.raises(ValueError):
        codec.read_varint(b"\x80", 0, bits)


def test_varint_size(spark):
    values = [0, 127, 128, 1 << 14, (1 << 21) - 1, (1 << 62), -1]
    rows = spark.createDataFrame([(v,) for v in values], "n long")
    got = [r[0] for r in rows.select(keys.varint_size(F.col("n"))).collect()]
    assert got == [len(codec.varint(v)) for v in values]


def test_blocks_and_footer():
    entries = [(f"key{i:05d}".encode(), b"v" * (i % 7)) for i in range(100)]
    for restart in (1, 2, 16, 200):
        assert codec.decode_block(codec.encode_block(entries, restart)) == entries
    assert codec.encode_block([]) == b"\0\0\0\0"
    assert len(codec.footer((1, 2), (300, 70000))) == 48
    assert codec.read_footer(codec.footer((1, 2), (300, 70000))) == ((1, 2), (300, 70000))
    with pytest.raises(ValueError):
        codec.read_footer(bytes(48))


def test_logs():
    rng = random.Random(301)
    small = [b"", b"x", b"dog chases cat"]
    large = [bytes(rng.randrange(256) for _ in range(4000)) * 20 for _ in range(3)]
    exact = [b"a" * (codec.LOG_BLOCK - codec.LOG_HEADER), b"b" * (codec.LOG_BLOCK - 2 * codec.LOG_HEADER - 3), b"c"]
    for records in (small, large, exact, [*small, *large, *exact]):
        data = codec.write_log(records)
        assert codec.read_log(data) == (records, 0)
    data = bytearray(codec.write_log(large))
    data[100] ^= 1
    records, dropped = codec.read_log(bytes(data))
    assert records == large[1:] and dropped >= 80_000


def test_batches():
    operations = [(b"a", b"1"), (b"b", None), (b"a", b"")]
    data = codec.encode_batch(41, operations)
    assert codec.decode_batch(data) == [(41, b"a", b"1"), (42, b"b", None), (43, b"a", b"")]
    with pytest.raises(ValueError):
        codec.decode_batch(data[:8] + b"\x09\0\0\0" + data[12:])


def test_orders(spark):
    rows = spark.createDataFrame([(v,) for v in (5, -1, 0, -(1 << 63), (1 << 63) - 1, 256)], "n long")
    got = [r["n"] for r in rows.orderBy(keys.long_key(F.col("n"))).collect()]
    assert got == sorted(r["n"] for r in rows.collect())


@pytest.mark.parametrize(
    ("start", "limit", "want"),
    [(b"abc1xyz", b"abc5", b"abc2"), (b"abc", b"abcd", b"abc"), (b"a\xff", b"b", b"a\xff"), (b"abc1", b"abc2", b"abc1"), (b"", b"x", b"")],
)
def test_separator(spark, start, limit, want):
    rows = spark.createDataFrame([(bytearray(start), bytearray(limit))], "a binary, b binary")
    assert bytes(rows.select(keys.separator(F.col("a"), F.col("b"))).first()[0]) == want


@pytest.mark.parametrize(("key", "want"), [(b"abc", b"b"), (b"\xff\xffa", b"\xff\xffb"), (b"\xff", b"\xff"), (b"", b"")])
def test_successor(spark, key, want):
    rows = spark.createDataFrame([(bytearray(key),)], "k binary")
    assert bytes(rows.select(keys.successor(F.col("k"))).first()[0]) == want


def test_block_seek_is_the_lower_bound():
    entries = [(b"k%04d" % i, b"v%d" % i) for i in range(0, 200, 3)]
    for restart in (1, 3, 16, 500):
        block = codec.encode_block(entries, restart)
        for n in range(-1, 205):
            target = b"k%04d" % n if n >= 0 else b""
            assert codec.block_seek(block, target) == next((e for e in entries if e[0] >= target), None)
    assert codec.block_seek(codec.encode_block([]), b"a") is None


def test_edits_come_back():
    records = [("comparator", b"order"), ("log_number", 7), ("next_file", 300), ("last_sequence", 1 << 40), ("compact_pointer", 2, b"key"),
               ("deleted_file", 1, 9), ("new_file", 0, 10, 4096, b"", b"\xff" * 200), ("previous_log", 0)]
    data = codec.encode_edit(records)
    assert codec.decode_edit(data) == records
    assert codec.decode_edit(b"") == []
    for wrong in (b"\x08", data[:1] + b"\x7f", data[:-1]):
        with pytest.raises(ValueError):
            codec.decode_edit(wrong)


def test_number_columns(spark):
    numbers = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -(2**63), None]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    row = frame.select("n", codec.varint64("n").alias("v"), codec.little_long(F.col("n")).alias("l"), codec.little_int(F.col("n")).alias("i"))
    for r in row.select("*", codec.varint64_value("v").alias("back"), codec.little_value(F.col("l"), 8).alias("eight")).collect():
        if r["n"] is None:
            assert r["v"] is None and r["back"] is None and r["i"] is None
            continue
        assert bytes(r["v"]) == codec.varint(r["n"]) and r["back"] == r["n"] == r["eight"]
        assert bytes(r["i"]) == (r["n"] & 0xFFFFFFFF).to_bytes(4, "little")
    for wrong in (b"", b"\x80", b"\x80" * 10 + b"\x01"):
        with pytest.raises(Exception, match="no end"):
            spark.createDataFrame([(bytearray(wrong),)], "v binary").select(codec.varint64_value("v")).collect()


def test_slice_hash(spark):
    texts = [b"", b"a", b"\x80\xff", b"some longer text" * 9]
    rows = spark.createDataFrame([(bytearray(t),) for t in texts], "t binary").select("t", codec.slice_hash(F.col("t")).alias("h"))
    for r in rows.collect():
        total = len(r["t"])
        for byte in r["t"]:
            total = total * 31 + (byte - 256 if byte > 127 else byte)
        assert r["h"] == (total + 2**31) % 2**32 - 2**31
