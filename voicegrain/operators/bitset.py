"""A bounded superset of keys as bitmaps, to drop rows that surely have no partner before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one of Spark's bitmaps, and bitmaps of a set: broadcast as 1 MB at most, whatever the number of keys.
BITMAP = 32768
BITMAPS = 256


def _bit(key: Column, bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("bit")), F.lit(bitmaps * BITMAP))


def bit_set(keys: DataFrame, key: str, bitmaps: int = BITMAPS) -> DataFrame:
    """``_part, _bitmap``: combined on the map side, at most ``bitmaps`` rows."""
    bit = _bit(F.col(key), bitmaps)
    return keys.select((bit / BITMAP).cast("int").alias("_part"), (bit % BITMAP).alias("_place")).groupBy("_part").agg(
        F.bitmap_construct_agg("_place").alias("_bitmap"))


def maybe_in(df: DataFrame, key: str, found: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """The rows of ``df`` whose key may be in the set; no row that is in it is lost."""
    columns = df.columns
    bit = _bit(F.col(key), bitmaps)
    placed = df.withColumns({"_part": (bit / BITMAP).cast("int"), "_place": (bit % BITMAP)})
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright("_place", 3) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = F.getbit(byte.cast("int"), (F.col("_place") % 8).cast("int")) == 1
    return placed.join(F.broadcast(found), "_part").where(hit).select(*columns)
