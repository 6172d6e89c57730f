"""Length norms in one byte: two explicit mantissa bits, five-bit exponents around zero point 15."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(byte: int) -> float:
    """The float32 that a norm byte stands for."""
    byte &= 0xFF
    return 0.0 if byte == 0 else struct.unpack(">f", struct.pack(">I", (byte << 21) + (48 << 24)))[0]


def encode(value: float) -> int:
    """The greatest byte whose float isn't above value. Zero and negative values give 0, other values below the least give 1."""
    value = np.float32(value)
    if not value > 0:
        return 0
    bits = struct.unpack(">i", struct.pack(">f", value))[0] >> 21
    return 1 if bits <= 384 else 255 if bits >= 640 else bits - 384


TABLE = [decode(b) for b in range(256)]


def length_norm(n: int) -> int:
    return encode(np.float32(1 / np.sqrt(n))) if n > 0 else 0


def steps(most: int = 1 << 24) -> list[tuple[int, int]]:
    """(least length, byte) of each byte that lengths up to most can have, by length."""
    out, lo = [], 1
    while lo <= most:
        byte, hi, step = length_norm(lo), lo, 1
        while length_norm(hi + step) == byte:
            hi, step = hi + step, step * 2
        while step:
            while length_norm(hi + step) == byte:
                hi += step
            step //= 2
        out.append((lo, byte))
        lo = hi + 1
    return out


STEPS = steps()


def norm_byte(length: Column) -> Column:
    """Byte of a field of so many tokens, without boost; null for an empty field."""
    out = F.lit(None).cast("int")
    for lo, byte in STEPS:
        out = F.when(length >= lo, F.lit(byte)).otherwise(out)
    return out


def boosted_byte(length: Column, boost: Column) -> Column:
    """Byte of a field of so many tokens with an index-time boost."""
    value = (boost.cast("float") * (F.lit(1.0) / F.sqrt(F.when(length > 0, length))).cast("float")).cast("float")
    below = F.filter(F.array(*[F.lit(x).cast("float") for x in TABLE[1:]]), lambda x: x <= value)
    return F.when(length <= 0, F.lit(None)).when(value > 0, F.greatest(F.size(below), F.lit(1))).otherwise(F.lit(0)).cast("int")


def norm_value(byte: Column) -> Column:
    """Float of a norm byte."""
    return F.element_at(F.array(*[F.lit(x).cast("float") for x in TABLE]), byte + 1)


def length_value(length: Column) -> Column:
    """Float norm of a field of so many tokens, without boost."""
    out = F.lit(None).cast("float")
    for lo, byte in STEPS:
        out = F.when(length >= lo, F.lit(decode(byte)).cast("float")).otherwise(out)
    return out


def sql_length_value(length: str) -> str:
    """The same in SQL."""
    return "case " + " ".join(f"when {length} >= {lo} then cast({decode(b)!r} as float)" for lo, b in reversed(STEPS)) + " end"


def sql_length_byte(length: str) -> str:
    return "case " + " ".join(f"when {length} >= {lo} then {b}" for lo, b in reversed(STEPS)) + " end"
