"""Keys, orders and packed sequence numbers as column expressions.

Spark orders BINARY by unsigned bytes, a shorter prefix first, which is the
engine's default order. Another order is a sort-key expression: a function from
the key column to a column whose natural order is the wanted one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Order = Callable[[Column], Column]
DELETION, VALUE = 0, 1
MAX_SEQUENCE = (1 << 56) - 1


def bytewise(key: Column) -> Column:
    return key


def long_key(n: Column) -> Column:
    """Eight bytes, big-endian, the sign bit flipped: bytewise order is numeric order."""
    hexed = F.hex(n.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return F.unhex(F.lpad(hexed, 16, "0"))


def number_key(n: Column, width: int = 16) -> Column:
    """A decimal number with leading zeros."""
    return F.lpad(n.cast("string"), width, "0")


def padded(n: Column, width: int) -> Column:
    """``printf('%0<width>d')``: a longer number stays whole, a sign comes first; null stays null."""
    return F.when(n.isNotNull(), F.format_string(f"%0{width}d", n))


def test_key(n: Column) -> Column:
    return F.concat(F.lit("key"), padded(n, 6))


def wrapped_product(a: Column, b: Column) -> Column:
    """a * b modulo 2**64 as a long, where ``*`` fails beyond 64 bits.

    Halves of 32 bits by quarters of 16, so that no step exceeds 2**50.
    """
    low, quarter = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")
    a, b = a.cast("long"), b.cast("long")
    al, ah, bl, bh = a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)

    def parts(x: Column, y: Column) -> tuple[Column, Column]:
        """x * y as (what it has under 2**49, a number of times 2**32)."""
        upper = F.shiftrightunsigned(x, 16) * y
        return x.bitwiseAND(quarter) * y + F.shiftleft(upper.bitwiseAND(quarter), 16), F.shiftrightunsigned(upper, 16)

    under, over = parts(al, bl)
    over = over + F.shiftrightunsigned(under, 32) + parts(ah, bl)[0] + parts(bh, al)[0]
    return F.shiftleft(over, 32).bitwiseOR(under.bitwiseAND(low))


def pack(seq: Column, vt: Column) -> Column:
    """Sequence number and value type in one long."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(vt.cast("long"))


def unpack_seq(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 8)


def unpack_type(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(255).cast("long"))


def varint_size(n: Column) -> Column:
    """Bytes of the variable-length form; a negative long takes ten."""
    sized = F.when(n < 0, 10)
    for size in range(1, 9):
        sized = sized.when(n < F.lit(1 << (7 * size)), size)
    return sized.otherwise(9)


def crc_mask(c: Column) -> Column:
    """Rotate right by 15 bits and add the constant, modulo 2**32; ``c`` is a long in that range."""
    low = F.lit(0xFFFFFFFF).cast("long")
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(low))
    return (turned + F.lit(0xA282EAD8).cast("long")).bitwiseAND(low)


def crc_unmask(m: Column) -> Column:
    low = F.lit(0xFFFFFFFF).cast("long")
    turned = (m - F.lit(0xA282EAD8).cast("long")).bitwiseAND(low)
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15).bitwiseAND(low))


def shared_prefix(key: Column, before: Column) -> Column:
    """Length of the common prefix of two binary keys (0 if one is null)."""
    pairs = F.sequence(F.lit(1), F.least(F.length(key), F.length(before)))
    grown = F.aggregate(
        pairs,
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(key, i, F.lit(1)) == F.substring(before, i, F.lit(1))), i).otherwise(acc),
    )
    empty = (F.length(key) == 0) | (F.length(before) == 0)
    return F.when(before.isNull() | key.isNull() | empty, 0).otherwise(grown)


def separator(start: Column, limit: Column) -> Column:
    """The shortest binary key in [start, limit): the first byte that differs is raised by one if it can be."""
    shared = shared_prefix(start, limit)
    byte = F.conv(F.hex(F.substring(start, shared + 1, F.lit(1))), 16, 10).cast("int")
    other = F.conv(F.hex(F.substring(limit, shared + 1, F.lit(1))), 16, 10).cast("int")
    raised = F.concat(F.substring(start, F.lit(1), shared), F.unhex(F.lpad(F.hex((byte + 1).cast("long")), 2, "0")))
    can = (shared < F.length(start)) & (shared < F.length(limit)) & (byte < 255) & (byte + 1 < other)
    return F.when(can, raised).otherwise(start)


def successor(key: Column) -> Column:
    """A short key that isn't smaller: the first byte under 0xff is raised and the rest dropped."""
    at = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == 0) & (F.substring(key, i, F.lit(1)) != F.lit(bytearray(b"\xff"))), i).otherwise(acc),
    )
    byte = F.conv(F.hex(F.substring(key, at, F.lit(1))), 16, 10)
    raised = F.concat(F.substring(key, F.lit(1), at - 1), F.unhex(F.lpad(F.hex(byte.cast("long") + 1), 2, "0")))
    return F.when((F.length(key) == 0) | (at == 0), key).otherwise(raised)
