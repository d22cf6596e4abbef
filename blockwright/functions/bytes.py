"""Byte-level column functions: varints, big-endian fields, hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_length(v: Column) -> Column:
    """Bytes of the unsigned LEB128 form."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7.0)).cast("int")


def varint(v: Column) -> Column:
    """Unsigned LEB128 bytes; a negative value is an error."""
    v = F.when(v < 0, F.raise_error("varint of a negative value").cast("long")).otherwise(v.cast("long"))
    n = varint_length(v)
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", v, i * 7).bitwiseAND(F.lit(127)).bitwiseOR(F.when(i < n - 1, F.lit(128)).otherwise(F.lit(0)))), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def varint_value(b: Column) -> Column:
    """(value, length) of the varint at the start of a binary; null where it doesn't end within 10 bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(b, 1, 10)).substr(2 * i + 1, F.lit(2)), 16, 10).cast("long")
    bytes_ = F.transform(F.sequence(F.lit(0), F.least(F.length(b), F.lit(10)) - 1), byte)
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        v = a["v"] + F.call_function("shiftleft", x.bitwiseAND(F.lit(127).cast("long")), a["n"] * 7)
        return F.when(a["done"], a).otherwise(F.struct(v.alias("v"), (a["n"] + 1).alias("n"), (x < 128).alias("done")))

    got = F.aggregate(bytes_, zero, step)
    return F.when((F.length(b) > 0) & got["done"], F.struct(got["v"].alias("value"), got["n"].alias("length")))


def big_endian(v: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))


def hash_prefix(b: Column, bits: int) -> Column:
    """The top bits of SHA-256 as a number; 0 for no bits. Up to 60 bits."""
    if bits <= 0:
        return F.lit(0).cast("long")
    digits = -(-bits // 4)
    return F.shiftright(F.conv(F.substring(F.sha2(b, 256), 1, digits), 16, 10).cast("long"), 4 * digits - bits)
