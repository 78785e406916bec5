"""Joins that hold when one key owns a large part of the rows, and size-checked broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# Largest side that is ever broadcast: rows when the caller can prove a row bound on narrow rows,
# bytes when the side has to be measured.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# A task makes about so many rows out of few (see ``dealt_for``).
MADE_ROWS = 50_000

# A key with more than this share of all rows is split, so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.001


def measured_bytes(df: DataFrame) -> int:
    """Size of the table's content: text by its length, every other column by 16 bytes."""
    parts = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, StringType)
        else F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        if f.dataType.typeName() in ("array", "struct", "map") else F.lit(16)
        for f in df.schema.fields
    ]
    return df.agg(F.sum(reduce(lambda a, b: a + b, parts).cast("bigint"))).first()[0] or 0


def small_enough(df: DataFrame, rows_at_most: int | None = None) -> bool:
    """Whether ``df`` may be broadcast: by a proven bound on narrow rows, else by measuring it."""
    if rows_at_most is not None:
        return rows_at_most <= BROADCAST_ROWS
    return measured_bytes(df) <= BROADCAST_BYTES


def lookup_join(
    big: DataFrame, side: DataFrame, on, how: str = "inner", rows_at_most: int | None = None
) -> DataFrame:
    """Join with a side that is usually small: broadcast within the size limit, shuffled beyond it."""
    return big.join(F.broadcast(side) if small_enough(side, rows_at_most) else side, on, how)


def dealt_for(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as the ``each`` rows need that every one of them becomes.

    A small table lies in one task, whatever is made of it there, and adaptive execution would put it back into one.
    """
    tasks = -(-df.count() * each // MADE_ROWS)
    return df.repartition(max(1, tasks), *keys)


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys owning more than ``share`` of the rows, with the number of slices each is cut into.

    Counting combines on the map side; the result has fewer than ``1 / share`` rows.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(counts.agg(F.sum("_rows")).scalar() * F.lit(share), F.lit(1.0))
    return counts.where(F.col("_rows") > limit).select(
        key, F.ceil(F.col("_rows") / limit).cast("int").alias("_slices")
    )


def skew_join(
    big: DataFrame, side: DataFrame, key: str, spread_by: list[str], how: str = "inner", share: float = HEAVY_SHARE
) -> DataFrame:
    """Equi join of a table that may be dominated by few keys with a side holding few rows per key.

    Rows of heavy keys are cut into slices by the hash of ``spread_by`` (columns that vary within a
    key) and the side's rows of these keys are repeated once per slice; all other keys have one slice.
    """
    heavy = F.broadcast(heavy_keys(big, key, share))
    sliced = (
        big.join(heavy, key, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.coalesce("_slices", F.lit(1))).cast("int"))
        .drop("_slices")
    )
    repeated = (
        side.join(heavy, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return sliced.join(repeated, [key, "_slice"], how).drop("_slice")
