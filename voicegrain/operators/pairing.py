"""Pairing profiles with items, questions, annotations and posts of other users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voicegrain.operators.batching import in_order
from voicegrain.operators.drawing import draw, draw_others
from voicegrain.operators.post_store import PostStore
from voicegrain.operators.ranking import (
    bucket_starts, hash_bucket, hash_number, key_hash, top_k,
)
from voicegrain.operators.skew import dealt_for, lookup_join, skew_join
from voicegrain.session import checkpoint

#: Posts of a stretch of the line of all posts; a stretch holds no more users.
LINE_WIDTH = 1024


def pair_with_first(many: DataFrame, few: DataFrame, n: int) -> DataFrame:
    """Every row of ``many`` with the first ``n`` rows of ``few`` by its dense ``position``.

    Each row names the positions it wants and meets them by an equi join; ``few`` is cut to ``n``
    rows first and sent to the scan of ``many`` when its measured size allows.
    """
    few = few.where(F.col("position") < n)
    count = few.agg(F.count(F.lit(1))).scalar()
    wanted = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return lookup_join(many.withColumn("position", F.explode(wanted)), few, "position")


def pair_with_items(profiles: DataFrame, pool: DataFrame, n: int, seed, key: str = "user_id") -> DataFrame:
    """Each profile with ``min(n, pool)`` different random items; ``pool`` has ``position, item_description``.

    The pool is only ever joined on drawn positions. Draws spread evenly over positions, so no
    position is hot unless the pool is tiny, and then it is broadcast. Profiles are dealt to tasks by the pairs they become.
    """
    sized = dealt_for(profiles, n, key).withColumn("_pool", pool.agg(F.count(F.lit(1))).scalar())
    drawn = sized.select("*", F.posexplode(draw(seed, F.col("_pool"), n, key)).alias("item_no", "position")).drop("_pool")
    return lookup_join(drawn, pool.select("position", "item_description"), "position").drop("position")


def synthetic_histories(rows: DataFrame, pool: DataFrame, low: int, high: int, seed) -> DataFrame:
    """For every ``history_id`` a history of ``[low, high)`` random items (exactly ``low`` when equal)
    and one candidate.

    A pool with too few items shrinks the history to ``pool - 1``. Rows whose candidate text also
    occurs in the history are dropped. ``rows`` is ``spark.range(n)`` for n histories.
    """
    total = pool.agg(F.count(F.lit(1))).scalar()
    span = max(high - low, 1)
    rows = dealt_for(rows, high, "history_id").select(
        "history_id",
        F.least(F.lit(low) + hash_number(f"{seed}-size", "history_id") % span, total - 1).alias("history_size"),
        total.alias("_pool"),
    )
    drawn = rows.select(
        "history_id", "history_size",
        F.posexplode(draw(seed, F.col("_pool"), F.col("history_size") + 1, "history_id")).alias("item_no", "position"),
    )
    named = lookup_join(drawn, pool.select("position", "item_description"), "position")
    return (
        named.groupBy("history_id", "history_size").agg(in_order("item_no", "item_description").alias("_items"))
        .select(
            "history_id", "history_size",
            F.slice("_items", F.lit(1), F.col("history_size").cast("int")).alias("history"),
            F.element_at("_items", -1).alias("candidate"),
        )
        .where(~F.array_contains("history", F.col("candidate")))
    )


def related_profiles(
    questions: DataFrame, annotation: DataFrame, n: int, cap: int | None, seed
) -> DataFrame:
    """Questions with strictly more than ``n`` different annotated profiles, with up to ``cap`` of them.

    ``cap`` None keeps all. Pairs are made distinct first and kept, so annotations are parsed once. With a cap a
    question has few rows to join back; without one, questions that dominate the annotation are cut into slices.
    """
    pairs = checkpoint(annotation.select("question", "user_profile").distinct())
    counts = pairs.groupBy("question").agg(F.count(F.lit(1)).alias("n_related")).where(F.col("n_related") > n)
    facts = questions.join(counts, "question")
    if cap is not None:
        chosen = top_k(pairs.withColumn("_hash", key_hash(seed, "question", "user_profile")),
                       ["question"], ["_hash", "user_profile"], cap).drop("_hash", "rank")
        return chosen.join(facts, "question")
    return skew_join(pairs, facts, "question", ["user_profile"])


def user_blocks(users: DataFrame) -> DataFrame:
    """Users laid out one after another in hash order: ``block`` is the number of posts before a user's.

    The running sum is taken per hash bucket and added to the total of earlier buckets.
    """
    hashed = users.withColumn("_hash", key_hash("block", "user")).withColumn("_bucket", hash_bucket(F.col("_hash")))
    starts = bucket_starts(hashed, "_bucket", F.col("n_posts"))
    earlier = Window.partitionBy("_bucket").orderBy("_hash", "user").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.join(F.broadcast(starts), "_bucket")
        .withColumn("block", (F.col("_start") + F.coalesce(F.sum("n_posts").over(earlier), F.lit(0))).cast("bigint"))
        .drop("_hash", "_bucket", "_start", "_size")
    )


def self_positives(
    profiles: DataFrame, store: PostStore, exclude: int, most: int, seed, eligible: DataFrame | None = None
) -> DataFrame:
    """Up to ``most`` own posts of each profile's user behind the first ``exclude``, in hash order (``rank``).

    Only places of the profiles' users are ranked, without their texts. ``eligible`` further limits them by
    ``post_id``, after the prefix was excluded, and its other columns come along. ``profiles`` has ``profile_id, user``. The
    result, a few places per profile, is kept on reliable storage: it is both counted and fetched.
    """
    later = store.of_users(profiles).where(F.col("position") >= exclude)
    if eligible is not None:
        later = later.join(eligible, "post_id")
    hashed = later.withColumn("_hash", key_hash(seed, "post_id"))
    best = top_k(hashed, ["user"], ["_hash", "post_id"], most).drop("_hash", "ord")
    return checkpoint(profiles.select("profile_id", "user").join(best, "user"))


def positive_counts(profiles: DataFrame, positives: DataFrame) -> DataFrame:
    """All profiles with the number of their positives."""
    counts = positives.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_positive"))
    return profiles.join(counts, "profile_id", "left").na.fill(0, ["n_positive"])


def other_users(profiles: DataFrame, users: DataFrame, total: int, per_query: int, seed) -> DataFrame:
    """Each profile with ``int((total - positives) / per_query)`` different users other than its own.

    ``profiles`` has ``profile_id, user, n_positive``; ``users`` has ``user, user_position, n_posts``.
    """
    own = profiles.join(users.select("user", "user_position"), "user", "left").withColumn(
        "_users", users.agg(F.count(F.lit(1))).scalar())
    wanted = F.floor((F.lit(total) - F.col("n_positive")) / per_query)
    drawn = dealt_for(own, max(1, total // per_query), "profile_id").select(
        "profile_id", "n_positive",
        F.posexplode(draw_others(seed, F.col("_users"), F.col("user_position"), wanted, "profile_id")).alias("other_no", "user_position"),
    )
    others = users.select("user_position", F.col("user").alias("other"), "n_posts")
    return lookup_join(drawn, others, "user_position").drop("user_position")


def posts_of_others(pairs: DataFrame, n, seed) -> DataFrame:
    """The places of ``min(n, posts)`` random posts of each pair's other user, numbered ``post_no`` from 0."""
    return checkpoint(pairs.select(
        "*", F.posexplode(draw(seed, F.col("n_posts"), n, "profile_id", "other")).alias("post_no", "position")
    ).drop("n_posts"))


def other_posts(profiles: DataFrame, users: DataFrame, total: int, seed, width: int = LINE_WIDTH) -> DataFrame:
    """The places of ``total - positives`` different posts of anybody else for each profile.

    All posts lie in one line, user after user. A profile's own block ``[b, b + n)`` is skipped by
    drawing from the other ``M - n`` places and counting on from the block's end. The line is cut into stretches of
    ``width`` posts; a drawn place meets only the users whose blocks reach into its stretch, never a post.
    """
    blocks = checkpoint(user_blocks(users.select("user", "n_posts")))
    m = users.agg(F.sum("n_posts")).scalar()
    own = profiles.join(blocks, "user", "left").select(
        "profile_id", (F.lit(total) - F.col("n_positive")).alias("_wanted"), m.alias("_all"),
        F.coalesce("n_posts", F.lit(0)).alias("_own"), F.coalesce("block", F.lit(0)).alias("_block"),
    )
    line = F.transform(
        draw(seed, F.col("_all") - F.col("_own"), F.col("_wanted"), "profile_id"),
        lambda d: (F.col("_block") + F.col("_own") + d) % F.col("_all"),
    )
    drawn = dealt_for(own, total, "profile_id").select("profile_id", F.posexplode(line).alias("post_no", "place")).withColumn("_stretch", F.expr(f"place div {width}"))
    reached = blocks.select(
        F.col("user").alias("other"), "block", "n_posts",
        F.explode(F.sequence(F.expr(f"block div {width}"), F.expr(f"(block + n_posts - 1) div {width}"))).alias("_stretch"),
    )
    found = drawn.join(reached, "_stretch").where("place >= block and place < block + n_posts")
    return checkpoint(found.select("profile_id", "post_no", "other", (F.col("place") - F.col("block")).alias("position")))


def query_batches(picked: DataFrame, group: list[str], number: str, size: int, *more: str) -> DataFrame:
    """Posts of each group in batches of ``size`` by their number; the last may be short. ``more`` columns become arrays too.

    Groups hold at most the number of posts drawn for one profile.
    """
    batch = F.floor((F.col(number)) / size).cast("bigint").alias("batch")
    lists = [in_order(number, name).alias(name) for name in more]
    return picked.groupBy(*group, batch).agg(in_order(number, "tweet").alias("tweets"), *lists)
