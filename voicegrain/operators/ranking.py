"""Exact ranks and top-k without collecting a group, or the whole table, into one task.

Every random draw of the engine is a *hash rank*: the position of a row when rows are ordered by the
md5 of a seed and the row's key. It depends on the data only, never on partitions or row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Hash ranks are cut into this many ordered buckets: the first four hex digits of the md5.
HASH_BUCKETS = 1 << 16

# Ordinals are cut into runs of this width, so a bucket never holds more rows than that, and so many
# runs are summed together before the sums of all runs are.
ORDINAL_WIDTH = 1 << 20
RUNS_TOGETHER = 1 << 12

# A group's rows are first pruned in this many independent slices.
SLICES = 64

# Samples up to this size are the rows of lowest hash that tasks keep in one pass, as many as they may be, and merge.
ONE_PASS = 100_000


def key_hash(seed, *keys) -> Column:
    """md5 of ``seed|key|key...`` as hex text; the order of hash ranks."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(seed, *keys) -> Column:
    """The first fifteen hex digits of the key hash as a number below 2^60."""
    return F.conv(F.substring(key_hash(seed, *keys), 1, 15), 16, 10).cast("bigint")


def hash_bucket(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int")


def ordinal_bucket(ordinal: str, width: int = ORDINAL_WIDTH) -> Column:
    return F.expr(f"`{ordinal}` div {width}")


def bucket_starts(df: DataFrame, bucket: str, size: Column | None = None) -> DataFrame:
    """Rows (or the total of ``size``) before each bucket and in it: ``bucket, _start, _size``.

    The running sum sees one row per bucket, at most ``HASH_BUCKETS``.
    """
    sizes = df.groupBy(bucket).agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("_size"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def hash_positions(df: DataFrame, seed, keys: list[str], position: str = "position") -> DataFrame:
    """Dense 0-based position of every row in hash order; ``keys`` identify a row.

    One shuffle on the bucket; rows spread evenly because the hash of a unique key does.
    """
    hashed = df.withColumn("_hash", key_hash(seed, *keys)).withColumn("_bucket", hash_bucket(F.col("_hash")))
    within = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    return (
        hashed.join(F.broadcast(bucket_starts(hashed, "_bucket")), "_bucket")
        .withColumn(position, (F.col("_start") + F.row_number().over(within) - 1).cast("bigint"))
        .drop("_hash", "_bucket", "_start", "_size")
    )


def hash_slice(df: DataFrame, seed, keys: list[str], first: int, end) -> DataFrame:
    """Rows whose hash position lies in ``first <= position < end``, exactly.

    Buckets inside the range pass as they are; only the two buckets at its ends are ranked. A range near the front
    needs one pass only. ``end`` may be a number or a column over the total, which is offered as ``_total``.
    """
    if isinstance(end, int) and end <= ONE_PASS:
        return lowest_by_hash(df, seed, keys, end, "_rank").where(F.col("_rank") > first).drop("_rank")
    return split_by_hash(df, seed, keys, first, end, "_in").where("_in").drop("_in")


def split_by_hash(df: DataFrame, seed, keys: list[str], first, end, flag: str) -> DataFrame:
    """All rows with a boolean ``flag``: hash position in ``first <= position < end``, exactly."""
    hashed = df.withColumn("_hash", key_hash(seed, *keys)).withColumn("_bucket", hash_bucket(F.col("_hash")))
    lo = F.lit(first) if not isinstance(first, Column) else first
    hi = F.lit(end) if not isinstance(end, Column) else end
    start, stop = F.col("_start"), F.col("_start") + F.col("_size")
    starts = (
        bucket_starts(hashed, "_bucket")
        .withColumn("_total", F.sum("_size").over(Window.partitionBy()))
        .select(
            "_bucket", "_start", lo.alias("_lo"), hi.alias("_hi"),
            F.when((start >= lo) & (stop <= hi), True).when((stop <= lo) | (start >= hi), False).alias(flag),
        )
    )
    placed = hashed.join(F.broadcast(starts), "_bucket")
    within = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    position = F.col("_start") + F.row_number().over(within) - 1
    edge = (
        placed.where(F.col(flag).isNull())
        .withColumn("_position", position)
        .withColumn(flag, (F.col("_position") >= F.col("_lo")) & (F.col("_position") < F.col("_hi")))
    )
    columns = [*df.columns, flag]
    return placed.where(F.col(flag).isNotNull()).select(columns).unionByName(edge.select(columns))


def lowest_by_hash(df: DataFrame, seed, keys: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows in hash order with their 1-based ``rank``, in one pass over ``df``.

    Every task keeps its ``n`` rows of lowest hash, slices of tasks merge theirs, and the last step sees ``SLICES * n``
    rows at most: a bottom-k sketch of the hash that carries its rows.
    """
    hashed = df.withColumn("_hash", key_hash(seed, *keys))
    return top_k(hashed, [], ["_hash", *keys], n, rank).drop("_hash")


def hash_sample(df: DataFrame, seed, keys: list[str], n: int, position: str | None = None) -> DataFrame:
    """The first ``min(n, rows)`` rows in hash order; with ``position`` also their place in it, from 0."""
    if n > ONE_PASS:
        found = hash_slice(df, seed, keys, 0, n)
        return hash_positions(found, seed, keys, position) if position else found
    found = lowest_by_hash(df, seed, keys, n, "_rank")
    return (found.withColumn(position, (F.col("_rank") - 1).cast("bigint")) if position else found).drop("_rank")


def position_in_group(
    df: DataFrame, group: list[str], ordinal: str, position: str = "position", width: int = ORDINAL_WIDTH
) -> DataFrame:
    """Dense 0-based position of each row within its group by a unique whole number.

    A group is ranked in runs of ``width`` ordinals, so a task never sees more than ``width`` rows
    of one group. The rows before each run come from two levels of sums, over the runs of a bundle and
    over bundles of ``RUNS_TOGETHER`` runs, so that no task meets all runs either.
    """
    run = df.withColumn("_run", ordinal_bucket(ordinal, width))
    sizes = run.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_size")).withColumn(
        "_bundle", F.expr(f"_run div {RUNS_TOGETHER}")
    )
    inside = Window.partitionBy(*group, "_bundle").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("_bundle").rowsBetween(Window.unboundedPreceding, -1)
    bundles = sizes.groupBy(*group, "_bundle").agg(F.sum("_size").alias("_sum")).withColumn(
        "_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))
    ).drop("_sum")
    starts = sizes.join(bundles, [*group, "_bundle"]).withColumn(
        "_start", F.col("_ahead") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    ).select(*group, "_run", "_start")
    within = Window.partitionBy(*group, "_run").orderBy(ordinal)
    return (
        run.join(starts, [*group, "_run"])
        .withColumn(position, (F.col("_start") + F.row_number().over(within) - 1).cast("bigint"))
        .drop("_run", "_start")
    )


def top_k(
    df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank", slices: int = SLICES
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``.

    Rows are pruned to ``k`` per group in every map task, then in ``slices`` parts of each group,
    so the last step sees at most ``slices * k`` rows of a group however large it is.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if slices > 1:
        part = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(slices)))
        df = (
            part.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
            .where(F.col("_rank") <= k)
            .drop("_part", "_rank")
        )
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        F.col(rank) <= k
    )
