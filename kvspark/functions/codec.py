"""Binary forms: varints, CRC32C, prefix-compressed blocks, chunked logs, batches.

What Spark has no expression for runs as Arrow-batched functions.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kvspark.functions.keys import crc_mask

#: Fixed values of the formats.
CASTAGNOLI = 0x82F63B78
MAGIC = 0xDB4775248B80FB57
LOG_BLOCK, LOG_HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
MASK_DELTA = 0xA282EAD8


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    return table.astype(np.uint32)


def crc32c_many(values: list[bytes], table: np.ndarray) -> np.ndarray:
    """CRC32C of many byte strings: a step for each position, over all strings that reach it."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    lengths = np.array([len(values[i]) for i in order], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    crc = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    reach = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    for at, n in enumerate(reach.tolist()):
        crc[:n] = table[(crc[:n] ^ data[starts[:n] + at]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC32C (Castagnoli) of a binary column as an unsigned number in a long; null stays null."""
    table = crc_table()
    for part in values:
        known = part.notna()
        out = pd.Series([None] * len(part), dtype="Int64")
        out[known.to_numpy()] = crc32c_many([bytes(v) for v in part[known]], table)
        yield out


def masked_crc32c(value: Column) -> Column:
    return crc_mask(crc32c(value))


def chunk_checksum(kind: Column, payload: Column) -> Column:
    """Of the chunk's type byte and payload."""
    return masked_crc32c(F.concat(F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), payload))


def block_checksum(data: Column, compression: Column) -> Column:
    """Of the block's bytes and the byte that tells its compression."""
    return masked_crc32c(F.concat(data, _byte(compression)))


def varint(n: int, bits: int = 64) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow. Negative numbers wrap."""
    n &= (1 << bits) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(number, place after it); ValueError when it doesn't end within its bits."""
    value = 0
    for i in range(-(-bits // 7)):
        if at >= len(data):
            raise ValueError("varint cut short")
        byte = data[at]
        at += 1
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            value &= (1 << bits) - 1
            return value - (1 << bits) if value >> (bits - 1) else value, at
    raise ValueError("varint has no end")


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def varint64(n: Column | str) -> Column:
    """``varint`` of a long column, ten bytes for negative numbers; null stays null."""
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    out = []
    for i in range(10):
        rest, more = F.shiftrightunsigned(n, 7 * i), F.shiftrightunsigned(n, 7 * i + 7) if i < 9 else F.lit(0)
        byte = _byte(rest.bitwiseAND(F.lit(127)).bitwiseOR(F.when(more != 0, 128).otherwise(0)))
        out.append(byte if i == 0 else F.when(rest != 0, byte).otherwise(F.unhex(F.lit(""))))
    return F.when(n.isNotNull(), F.concat(*out))


def varint64_value(data: Column | str) -> Column:
    """The long of a binary column that holds one varint; fails when it doesn't end within ten bytes."""
    data = F.col(data) if isinstance(data, str) else data
    at = lambda i: F.coalesce(F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long"), F.lit(0).cast("long"))
    value = at(0).bitwiseAND(F.lit(127))
    for i in range(1, 10):
        value = value.bitwiseOR(F.shiftleft(at(i).bitwiseAND(F.lit(127)), 7 * i))
    last = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("long")
    ends = (F.octet_length(data) > 0) & (F.octet_length(data) <= 10) & (last < 128)
    return F.when(data.isNull(), None).when(ends, value).otherwise(F.raise_error(F.lit("varint has no end")).cast("long"))


def prefixed(value: Column) -> Column:
    """A binary column after its length as a varint."""
    return F.concat(varint64(F.octet_length(value)), value)


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data), 32) + data


def little_long(n: Column) -> Column:
    """Eight bytes, little-endian."""
    return _turned(F.lpad(F.hex(n), 16, "0"), 8)


def little_int(n: Column) -> Column:
    """Four bytes, little-endian, of the lower 32 bits."""
    return _turned(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"), 4)


def little_value(data: Column, size: int) -> Column:
    """The long of ``size`` bytes (at most 8), little-endian; four bytes and fewer are unsigned."""
    value = F.lit(0).cast("long")
    for i in range(size):
        byte = F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")
        value = value.bitwiseOR(F.shiftleft(byte, 8 * i))
    return value


def slice_hash(data: Column) -> Column:
    """The 31-polynomial of the signed bytes from the length on, in 32 bits."""
    low = F.lit(0xFFFFFFFF).cast("long")
    digits = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    signed = lambda h: F.conv(h, 16, 10).cast("long").bitwiseXOR(F.lit(128)) - 128
    total = F.aggregate(digits, F.octet_length(data).cast("long"), lambda t, h: (t * 31 + signed(h)).bitwiseAND(low))
    return (total.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("int")


def _turned(hexed: Column, size: int) -> Column:
    return F.unhex(F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))]))


def internal_key(user_key: Column, packed: Column) -> Column:
    """User key followed by the packed sequence number, little-endian."""
    return F.concat(user_key, little_long(packed))


# Batches: sequence (8 bytes), count (4), then type, key and, for a put, value.


def encode_batch(first: int, operations: list[tuple[bytes, bytes | None]]) -> bytes:
    out = struct.pack("<qi", first, len(operations))
    for key, value in operations:
        out += bytes([0 if value is None else 1]) + length_prefixed(key)
        out += b"" if value is None else length_prefixed(value)
    return out


def decode_batch(data: bytes) -> list[tuple[int, bytes, bytes | None]]:
    """(sequence, key, value or None for a delete); ValueError if the count is wrong."""
    first, count = struct.unpack_from("<qi", data)
    at, out = 12, []
    while at < len(data):
        kind = data[at]
        if kind > 1:
            raise ValueError(f"value type {kind}")
        parts = []
        at += 1
        for _ in range(1 + kind):
            size, at = read_varint(data, at, 32)
            parts.append(data[at : at + size])
            at += size
        out.append((first + len(out), parts[0], parts[1] if kind else None))
    if len(out) != count:
        raise ValueError(f"{len(out)} operations, {count} expected")
    return out


# Blocks: entries with shared prefixes, restart places, their number.


def encode_block(entries: list[tuple[bytes, bytes]], restart: int = 16) -> bytes:
    out, places, before = bytearray(), [], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % restart:
            while shared < min(len(key), len(before)) and key[shared] == before[shared]:
                shared += 1
        else:
            places.append(len(out))
        out += varint(shared, 32) + varint(len(key) - shared, 32) + varint(len(value), 32) + key[shared:] + value
        before = key
    return bytes(out) + b"".join(struct.pack("<i", p) for p in places) + struct.pack("<i", len(places))


def decode_block(data: bytes) -> list[tuple[bytes, bytes]]:
    (restarts,) = struct.unpack_from("<i", data, len(data) - 4)
    stop, at, key, out = len(data) - 4 - 4 * restarts, 0, b"", []
    while at < stop:
        shared, at = read_varint(data, at, 32)
        rest, at = read_varint(data, at, 32)
        size, at = read_varint(data, at, 32)
        key = key[:shared] + data[at : at + rest]
        at += rest
        out.append((key, data[at : at + size]))
        at += size
    return out


def block_seek(data: bytes, target: bytes) -> tuple[bytes, bytes] | None:
    """The first entry whose key isn't under ``target``: the last restart below it by bisection, then in order."""
    (restarts,) = struct.unpack_from("<i", data, len(data) - 4)
    stop = len(data) - 4 - 4 * restarts
    places = struct.unpack_from(f"<{restarts}i", data, stop)

    def entry(at: int, before: bytes) -> tuple[int, bytes, bytes]:
        shared, at = read_varint(data, at, 32)
        rest, at = read_varint(data, at, 32)
        size, at = read_varint(data, at, 32)
        return at + rest + size, before[:shared] + data[at : at + rest], data[at + rest : at + rest + size]

    under = bisect_left(range(restarts), True, key=lambda i: entry(places[i], b"")[1] >= target)
    at, key = places[max(under - 1, 0)] if restarts else stop, b""
    while at < stop:
        at, key, value = entry(at, key)
        if key >= target:
            return key, value
    return None


def footer(meta: tuple[int, int], index: tuple[int, int]) -> bytes:
    """48 bytes: the handles of two blocks, padding, the magic number."""
    handles = b"".join(varint(n) for n in (*meta, *index))
    return handles.ljust(40, b"\0") + struct.pack("<Q", MAGIC)


def read_footer(data: bytes) -> tuple[tuple[int, int], tuple[int, int]]:
    if len(data) != 48 or struct.unpack_from("<Q", data, 40)[0] != MAGIC:
        raise ValueError("no footer")
    numbers, at = [], 0
    for _ in range(4):
        n, at = read_varint(data, at)
        numbers.append(n)
    return (numbers[0], numbers[1]), (numbers[2], numbers[3])


# Logs: blocks of 32 KiB with chunks: checksum (4), length (2), type (1), payload.


def _masked(kind: int, payload: bytes, table: list[int]) -> int:
    c = 0xFFFFFFFF  # one string at a time: numbers of Python are faster than arrays of one
    for byte in bytes([kind]) + payload:
        c = table[(c ^ byte) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def write_log(records: list[bytes]) -> bytes:
    table, out = crc_table().tolist(), bytearray()
    for record in records:
        at, begin = 0, True
        while True:
            room = LOG_BLOCK - len(out) % LOG_BLOCK
            if room < LOG_HEADER:
                out += b"\0" * room
                room = LOG_BLOCK
            part = record[at : at + room - LOG_HEADER]
            at += len(part)
            end = at == len(record)
            kind = (FULL if end else FIRST) if begin else (LAST if end else MIDDLE)
            out += struct.pack("<IHB", _masked(kind, part, table), len(part), kind) + part
            begin = False
            if end:
                break
    return bytes(out)


def read_log(data: bytes) -> tuple[list[bytes], int]:
    """(records, bytes dropped for wrong checksums, lengths or orders of chunks)."""
    table, at, out, dropped, held = crc_table().tolist(), 0, [], 0, None
    while at + LOG_HEADER <= len(data):
        room = LOG_BLOCK - at % LOG_BLOCK
        if room < LOG_HEADER:
            at += room
            continue
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        part = data[at + LOG_HEADER : at + LOG_HEADER + size]
        if size > room - LOG_HEADER or len(part) < size or kind not in (FULL, FIRST, MIDDLE, LAST) or _masked(kind, part, table) != crc:
            dropped += room + len(held or b"")
            held, at = None, at + room  # the rest of the block can't be trusted
            continue
        at += LOG_HEADER + size
        if kind in (FULL, FIRST):
            dropped += len(held or b"")
            held = part
        elif held is None:
            dropped += size
            continue
        else:
            held += part
        if kind in (FULL, LAST):
            out.append(held)
            held = None
    return out, dropped + len(held or b"")


# Edits of the manifest: tags with their fields.

#: Fixed values of the format: tag -> (name, fields); v: varint, b: length-prefixed bytes.
EDIT_TAGS = {
    1: ("comparator", "b"), 2: ("log_number", "v"), 3: ("next_file", "v"), 4: ("last_sequence", "v"), 5: ("compact_pointer", "vb"),
    6: ("deleted_file", "vv"), 7: ("new_file", "vvvbb"), 9: ("previous_log", "v"),
}


def encode_edit(records: list[tuple]) -> bytes:
    """Records (name, field, ...) in order."""
    tags, out = {name: (tag, kinds) for tag, (name, kinds) in EDIT_TAGS.items()}, b""
    for name, *fields in records:
        tag, kinds = tags[name]
        out += varint(tag, 32)
        for kind, field in zip(kinds, fields, strict=True):
            out += varint(field) if kind == "v" else length_prefixed(field)
    return out


def decode_edit(data: bytes) -> list[tuple]:
    """The records of an edit; ValueError for an unknown tag or one cut short."""
    at, out = 0, []
    while at < len(data):
        tag, at = read_varint(data, at, 32)
        if tag not in EDIT_TAGS:
            raise ValueError(f"tag {tag}")
        name, kinds = EDIT_TAGS[tag]
        fields = []
        for kind in kinds:
            n, at = read_varint(data, at)
            if kind == "b":
                if at + n > len(data):
                    raise ValueError("edit cut short")
                n, at = data[at : at + n], at + n
            fields.append(n)
        out.append((name, *fields))
    return out
