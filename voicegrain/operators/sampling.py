"""User and row sampling, history bounds, exact splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrain.lookups import HISTORY_BOUNDS
from voicegrain.operators.ranking import hash_sample, hash_slice, split_by_hash


def posts_per_user(posts: DataFrame) -> DataFrame:
    """Distinct users with their number of posts and first ordinal; combined before the shuffle."""
    return posts.groupBy("user").agg(F.count(F.lit(1)).alias("n_posts"), F.min("ord").alias("first_ord"))


def users_above(users: DataFrame, minimum: int) -> DataFrame:
    """Single-post path: strictly more posts than the minimum."""
    return users.where(F.col("n_posts") > minimum)


def users_with_batch(users: DataFrame, minimum: int, batch: int) -> DataFrame:
    """Multi-post path: at least the minimum, and at least one full batch."""
    return users.where((F.col("n_posts") >= minimum) & (F.col("n_posts") >= batch))


def pick_users(users: DataFrame, seed, n: int, start: int = -1) -> DataFrame:
    """``n`` users by hash order, from ``start`` on; -1 starts at the front.

    Different starts of one seed give disjoint shards, whatever the run.
    """
    first = max(start, 0)
    return hash_slice(users, seed, ["user"], first, first + n)


def first_rows(df: DataFrame, ordinal: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in ordinal order; all rows when ``n`` is None or negative."""
    return df if n is None or n < 0 else df.orderBy(ordinal).limit(n)


def sample_if_positive(df: DataFrame, seed, keys: list[str], n: int | None) -> DataFrame:
    return hash_sample(df, seed, keys, n) if n is not None and n > 0 else df


def split_exact(
    df: DataFrame, seed, keys: list[str], fraction: float, by: list[str] | None = None, column: str = "split"
) -> DataFrame:
    """``train`` for exactly ``round(fraction * rows)`` rows (half to even), ``test`` for the rest.

    With ``by`` the groups named there are split instead of rows, so a group is never torn apart.
    """
    cut = F.bround(F.col("_total") * F.lit(fraction)).cast("bigint")
    if by:
        groups = split_by_hash(df.select(*by).distinct(), seed, by, 0, cut, "_train")
        marked = df.join(groups, by)
    else:
        marked = split_by_hash(df, seed, keys, 0, cut, "_train")
    return marked.withColumn(column, F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def history_bounds(dataset: str, configured: dict[str, tuple[int, int]] | None = None) -> tuple[int, int]:
    """Configured bounds first, then the default table, else an error."""
    bounds = (configured or {}).get(dataset) or HISTORY_BOUNDS.get(dataset)
    if bounds is None:
        raise ValueError(f"no history bounds for dataset {dataset}")
    return int(bounds[0]), int(bounds[1])
