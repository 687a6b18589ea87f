"""A blocked Bloom filter made of DataFrame operations.

A key sets four bits of one 64-bit block, so a look-up reads one row of the filter. The filter has at most
``blocks`` rows whatever the number of keys, and may be sent to every executor; a longer list only makes more
false positives, which the exact join behind it removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 17
BITS = 4


def _mask(hashed: Column) -> Column:
    """Four bits of a 64-bit word, chosen by 24 bits of the hash."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(hashed, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed.bitwiseAND(F.lit((1 << 40) - 1)), F.lit(blocks)).cast("int")


def bloom_filter(keys: DataFrame, *columns: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, bits) over the keys in ``columns``; null keys are left out."""
    hashed = F.xxhash64(*columns)
    keys = keys.where(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 0)
    return keys.select(_block(hashed, blocks).alias("bloom_block"), _mask(hashed).alias("mask")).groupBy(
        "bloom_block").agg(F.bit_or("mask").alias("bloom_bits"))


def may_hold(table: DataFrame, bloom: DataFrame, *columns: str, blocks: int = BLOCKS,
             flag: str = "bloom_hit") -> DataFrame:
    """``table`` with ``flag``: false only for keys that are surely not listed. Moves no row of the table."""
    hashed = F.xxhash64(*columns)
    looked = table.withColumn("bloom_block", _block(hashed, blocks)).join(F.broadcast(bloom), "bloom_block", "left")
    hit = F.coalesce(F.col("bloom_bits").bitwiseAND(_mask(hashed)) == _mask(hashed), F.lit(False))
    return looked.withColumn(flag, hit).drop("bloom_block", "bloom_bits")
