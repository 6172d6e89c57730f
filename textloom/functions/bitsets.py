"""Sets of numbers as bits: a row (word, bits) for each 64 numbers that the set has any of.

A set grows with the highest number only where it has numbers, so it is distributed and never sized in advance. Sets are combined by a join on the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import trailing_zeros


def from_numbers(df: DataFrame, column: str) -> DataFrame:
    """The set of a column's numbers; nulls are left out, negative ones an error."""
    n = F.col(column).cast("long")
    n = F.when(n < 0, F.raise_error(F.lit("numbers of a bit set aren't negative"))).otherwise(n)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n").bitwiseAND(F.lit(63)).cast("int"))
    rows = df.where(F.col(column).isNotNull()).select(n.alias("n"))
    return rows.select(F.shiftright("n", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def to_numbers(bits: DataFrame) -> DataFrame:
    """``(n)``: the numbers of a set."""
    every = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    return bits.select("word", F.explode(every).alias("k")).select((F.col("word") * 64 + F.col("k")).alias("n"))


def _combined(a: DataFrame, b: DataFrame, how: str, bits: Column) -> DataFrame:
    out = a.join(b.select("word", F.col("bits").alias("other")), "word", how)
    return out.select("word", bits.alias("bits")).where("bits <> 0")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "inner", F.col("bits").bitwiseAND(F.col("other")))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "full", F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("other", F.lit(0))))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "left", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("long")))))


def cardinality(bits: DataFrame) -> DataFrame:
    """``(n)``: how many numbers the set has."""
    return bits.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def next_set(bits: DataFrame, least: int) -> DataFrame:
    """``(n)``: the least number of the set that isn't below the given one; null if there is none."""
    if least < 0:
        raise ValueError("numbers of a bit set aren't negative")
    high = F.lit(-1 << (least & 63)).cast("long") if least & 63 else F.lit(-1).cast("long")
    own = F.when(F.col("word") == least >> 6, F.col("bits").bitwiseAND(high)).otherwise(F.col("bits"))
    rows = bits.where(F.col("word") >= least >> 6).select("word", own.alias("bits")).where("bits <> 0")
    return rows.agg(F.min(F.col("word") * 64 + trailing_zeros(F.col("bits"))).alias("n"))
