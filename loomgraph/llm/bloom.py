"""Bloom filters as broadcast bitmaps, in DataFrame functions only.

A filter is a table (bucket, bitmap) of the cells of a bit table that enough rows hit; cells are counted by partial aggregation
before the shuffle of bare cell numbers, then packed into bitmaps of 4 KB. max_bits bounds what is broadcast (32 MB by default).
Beyond about max_bits / bits_per_row keys a filter lets more rows through than it must; it never holds one back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

HASHES, BITS_PER_ROW, MAX_BITS = 2, 16, 1 << 28


def _cell(key: Column, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(j)), F.lit(bits)) + 1


def _bit(bitmap: Column, cell: Column) -> Column:
    """Whether the cell's bit is set in its bitmap; false where there is no bitmap."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def size(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    bits = 1 << 15
    while bits < min(rows * bits_per_row, max_bits):
        bits *= 2
    return bits


def bitmaps(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """(bucket, bitmap) of the cells that at least so many rows of keys(key) hit."""
    cells = keys.select(F.explode(F.array_distinct(F.array(*[_cell(F.col("key"), j, bits) for j in range(HASHES)]))).alias("cell"))
    cells = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def with_maybe(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """rows(key, ..) and `maybe`: false only if the filter surely lacks the key. rows' other columns are the caller's own choice."""
    maybe = F.lit(True)
    for j in range(HASHES):
        side = F.broadcast(maps.select(F.col("bucket").alias(f"_b{j}"), F.col("bitmap").alias(f"_m{j}")))
        cell = _cell(F.col("key"), j, bits)
        rows = rows.join(side, F.bitmap_bucket_number(cell) == F.col(f"_b{j}"), "left")
        maybe = maybe & _bit(F.col(f"_m{j}"), cell)
    return rows.withColumn("maybe", maybe).drop(*[f"_{x}{j}" for x in "bm" for j in range(HASHES)])


def split(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, ..) whose key keys(key) surely lacks, and the other rows: only these need to meet the keys."""
    bits = size(keys.count())
    marked = with_maybe(rows, cut(bitmaps(keys, bits), "filter"), bits)
    return marked.where(~F.col("maybe")).drop("maybe"), marked.where("maybe").drop("maybe")
