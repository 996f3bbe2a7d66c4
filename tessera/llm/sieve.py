"""Splitting rows by whether a 64-bit hash may be in a set, without moving them: a bitmap of fixed size is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import free_prefix

#: The bitmap has 2 ** ROW_BITS rows at most (about 40 MB as a broadcast table), each with 64 bits.
ROW_BITS = 20


def _row(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - ROW_BITS)


def _bit(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 58 - ROW_BITS).bitwiseAND(F.lit(63)).cast("int")


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(row, mask) of the hashes in a long column, which is not null."""
    h = F.col(column)
    return hashes.groupBy(_row(h).alias("row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h))).alias("mask"))


def split(rows: DataFrame, hashed: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash may be in the set, and those whose hash is not; all columns, whatever their names. No row is shuffled.

    Of the hashes outside the set about one in 2 ** (ROW_BITS + 6) / its size is taken for one of it.
    """
    p = free_prefix(*rows.columns)
    h = F.coalesce(hashed, F.lit(0).cast("long"))
    marks = marks.select(F.col("row").alias(f"{p}row"), F.col("mask").alias(f"{p}mask"))
    met = rows.withColumns({f"{p}row": _row(h), f"{p}bit": _bit(h)}).join(F.broadcast(marks), f"{p}row", "left")
    hit = F.coalesce(F.getbit(f"{p}mask", F.col(f"{p}bit")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return met.where(hit).select(*own), met.where(~hit).select(*own)
