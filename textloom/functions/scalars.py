"""Scalar helpers: hashes, zig-zag, generations in base 36 and the file names made of them, logarithms and divisors, sizes of packed numbers, versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def murmur3_bytes(data: bytes, seed: int) -> int:
    """Murmur3 x86 32 of a byte string, as an unsigned number."""
    m = 0xFFFFFFFF
    h, n = seed & m, len(data) // 4 * 4
    for i in range(0, n, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m
        k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
        h ^= k
        h = (h << 13 | h >> 19) & m
        h = h * 5 + 0xE6546B64 & m
    if tail := data[n:]:
        k = int.from_bytes(tail, "little") * 0xCC9E2D51 & m
        h ^= ((k << 15 | k >> 17) & m) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def murmur3_rows(data: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3 x86 32 of many byte strings, those at ``data[off[k]:off[k + 1]]``: one step for each block of four bytes, over all strings that have it."""
    u = np.uint32
    n = np.diff(off)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    h = np.full(len(n), seed & 0xFFFFFFFF, u)

    def block(at, size):
        k = np.zeros(len(at), u)
        for i in range(size):
            k |= padded[at + i].astype(u) << u(8 * i)
        k = k * u(0xCC9E2D51)
        return (k << u(15) | k >> u(17)) * u(0x1B873593)

    for i in range(int(n.max(initial=0)) // 4):
        own = np.flatnonzero(n >= 4 * i + 4)
        x = h[own] ^ block(off[own] + 4 * i, 4)
        h[own] = (x << u(13) | x >> u(19)) * u(5) + u(0xE6546B64)
    for size in (1, 2, 3):
        own = np.flatnonzero(n % 4 == size)
        h[own] ^= block(off[own] + n[own] - size, size)
    h ^= n.astype(u)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return h ^ h >> u(16)


def murmur3(column: Column, seed: int = 0) -> Column:
    """Murmur3 x86 32 of a string or binary column as a long; null for null. Spark's own hash differs in the tail bytes."""

    @pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        here = values.notna().to_numpy()
        parts = [bytes(v) for v in values[here]]
        out = pd.Series(pd.NA, index=values.index, dtype="Int64")
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        out[here] = murmur3_rows(np.frombuffer(b"".join(parts), np.uint8), off, seed).astype(np.int64)
        return out

    return run(column.cast("binary"))


def string_hash(text: str) -> int:
    h = 0
    for b in text.encode():
        h = (h * 16777619 + b) & 0xFFFFFFFF
    return h


def rolling_hash(column: Column) -> Column:
    """``string_hash`` of a column: polynomial hash of the bytes in UTF-8, base 16777619, modulo 2**32."""
    pairs = F.hex(column.cast("binary"))
    byte = lambda i: F.conv(F.substring(pairs, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(pairs) > 0, F.sequence(F.lit(0), (F.length(pairs) / 2).cast("int") - 1)).when(column.isNotNull(), F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: (h * 16777619 + byte(i)).bitwiseAND(F.lit(0xFFFFFFFF)))


def zigzag(column: Column) -> Column:
    return F.shiftleft(column.cast("long"), 1).bitwiseXOR(F.shiftright(column.cast("long"), 63))


def unzigzag(column: Column) -> Column:
    return F.shiftrightunsigned(column, 1).bitwiseXOR(-column.bitwiseAND(F.lit(1).cast("long")))


def base36(column: Column) -> Column:
    """Lower-case base 36 of a generation number."""
    return F.lower(F.conv(column.cast("string"), 10, 36))


def from_base36(column: Column) -> Column:
    return F.conv(column, 36, 10).cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs."""

    @pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.gcd(x.to_numpy("int64", na_value=0), y.to_numpy("int64", na_value=0)))

    return F.when(a.isNotNull() & b.isNotNull(), run(F.coalesce(a, F.lit(0)).cast("long"), F.coalesce(b, F.lit(0)).cast("long")))


def integer_log(column: Column, base: int) -> Column:
    """Floor of the logarithm of a long, exact: how many powers of base up to it, less one; 0 where it isn't positive."""
    if base < 2:
        raise ValueError("the base must be 2 or more")
    powers = [base**k for k in range(1, 64) if base**k < 1 << 63]
    return F.when(column.isNotNull(), F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p <= column)))


def trailing_zeros(column: Column) -> Column:
    """Zero bits below the lowest one of a long; 64 for zero."""
    low = column.cast("long").bitwiseAND(F.negative(column.cast("long")))
    return F.when(column == 0, 64).when(column == -(1 << 63), 63).otherwise(F.bit_count(low - 1)).cast("int")


def bits_required(column: Column) -> Column:
    """Bits that hold a long taken as unsigned; 1 for zero."""
    return F.when(column < 0, 64).when(column == 0, 1).otherwise(integer_log(column, 2) + 1).cast("int")


def max_value(bits: Column) -> Column:
    """Greatest number of so many bits; that of 64 is the greatest long."""
    full = F.lit((1 << 63) - 1)
    return F.when(bits >= 63, full).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def packed_bytes(count: Column, bits: Column, single_block: bool = False) -> Column:
    """Bytes that hold ``count`` values of ``bits`` bits, one behind the other, or, with single_block, in whole 64-bit words that no value crosses."""
    if single_block:
        return (8 * F.ceil(count / F.floor(64 / bits))).cast("long")
    return F.floor((count.cast("decimal(20,0)") * bits + 7) / 8).cast("long")


def valid_utf16(units: Column) -> Column:
    """Whether an array of UTF-16 units has each high surrogate before a low one, and no low one elsewhere."""
    high, low = (lambda x: x.between(0xD800, 0xDBFF)), (lambda x: x.between(0xDC00, 0xDFFF))
    # 0: any may come, 1: a low one must come, 2: broken
    end = F.aggregate(units, F.lit(0), lambda s, x: F.when(s == 2, 2).when(s == 1, F.when(low(x), 0).otherwise(2)).when(low(x), 2).when(high(x), 1).otherwise(0))
    return end == 0


def version_number(column: Column) -> Column:
    """A number that orders versions ``major.minor[.bugfix[.prerelease]]``; null for the empty one and for what isn't a version: each part up to 255, and a prerelease of 1 or 2 only where minor and bugfix are 0."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(column, r"\."), F.lit(i)).cast("int"), F.lit(0))
    good = column.rlike(r"^\d{1,3}\.\d{1,3}(\.\d{1,3}(\.[12])?)?$") & (F.greatest(part(1), part(2), part(3)) <= 255) & ((part(4) == 0) | ((part(2) == 0) & (part(3) == 0)))
    return F.when(good, part(1) * (1 << 18) + part(2) * (1 << 10) + part(3) * 4 + part(4))


def on_or_after(a: Column, b: Column) -> Column:
    return version_number(a) >= version_number(b)


def generation_name(base: Column, ext: Column, generation: Column) -> Column:
    """File name of a generation: empty for -1, without a number for 0."""
    tail = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")
    return F.when(generation == -1, "").when(generation == 0, F.concat(base, tail)).otherwise(F.concat(base, F.lit("_"), base36(generation), tail))


def segment_file(name: Column, suffix: Column, ext: Column) -> Column:
    return F.concat(name, F.when(suffix != "", F.concat(F.lit("_"), suffix)).otherwise(""), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def segment_name(file: Column) -> Column:
    """The part of a file name before its suffix or extension; an underscore in the first place begins a name."""
    return F.when(file.rlike("^.[^_]*_"), F.regexp_extract(file, "^(.[^_]*)_", 1)).otherwise(F.regexp_extract(file, "^[^.]*", 0))


def strip_segment_name(file: Column) -> Column:
    """What follows the segment's name; the whole where nothing does."""
    rest = F.substring(file, F.length(segment_name(file)) + 1, F.length(file))
    return F.when(rest == "", file).otherwise(rest)


def file_generation(file: Column) -> Column:
    """The generation in a file name ``_segment[_generation][_codec_suffix].ext``, 0 without one; null for names that begin otherwise."""
    parts = F.split(F.regexp_extract(file, r"^_([^.]*)", 1), "_")
    return F.when(file.startswith("_"), F.when(F.size(parts).isin(2, 4), from_base36(parts[1])).otherwise(F.lit(0).cast("long")))
