"""Bounded gathers: posts into batches, tags into pages, answers per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.functions.replies import summary_answer
from voicegrain.functions.text import strip
from voicegrain.operators.ranking import top_k
from voicegrain.operators.skew import skew_join, small_enough
from voicegrain.session import checkpoint


def first_posts(posts: DataFrame, users: DataFrame, most: int, users_at_most: int | None = None) -> DataFrame:
    """The first ``most`` posts of each chosen user with their 1-based ``rank``.

    So many users as may be broadcast are sent to the posts; beyond that, posts of users who own much of the table are cut into slices.
    """
    named = users.select("user").distinct()
    few = users_at_most is not None and small_enough(named, users_at_most)
    chosen = posts.join(F.broadcast(named), "user") if few else skew_join(posts, named, "user", ["ord"])
    return top_k(chosen, ["user"], ["ord"], most)


def in_order(order: str, value: str) -> Column:
    """The group's values as an array sorted by ``order``; for groups with a known bound only."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])


def post_batches(first: DataFrame, size: int, most: int) -> DataFrame:
    """Ordered batches of ``size`` posts per user, the last may be short.

    Whole batches are taken until ``most`` posts are covered, so ``first`` must hold
    ``batch_cover(size, most)`` posts per user.
    """
    batch = F.floor((F.col("rank") - 1) / size).cast("bigint").alias("batch")
    return first.groupBy("user", batch).agg(in_order("rank", "tweet").alias("tweets"))


def batch_cover(size: int, most: int) -> int:
    """Posts in the whole batches that are needed to reach ``most``; never less than one batch."""
    return max(1, -(-most // size)) * size


def distinct_tags(descriptions: DataFrame, separator: str = ";") -> DataFrame:
    """Split descriptions into tags; trimmed, lower-cased, one row per user and tag. Blank and
    ``n/a`` tags are dropped."""
    parts = descriptions.select("user", F.explode(F.split("description", separator)).alias("tag"))
    tags = parts.select("user", F.lower(strip(F.col("tag"))).alias("tag"))
    return tags.where(~F.col("tag").isin("", "n/a")).distinct()


def tag_pages(tags: DataFrame, most: int = 2000) -> DataFrame:
    """One row per user and page with the sorted tags as ``descriptions``.

    A user with at most ``most`` tags has one page. More tags are spread over as many pages as they
    need, so that no list grows with a user's share of the data and no tag is lost. Tags are kept before they are
    counted, so replies are read once.
    """
    tags = checkpoint(tags)
    counts = tags.groupBy("user").agg(F.count(F.lit(1)).alias("n_tags"))
    pages = counts.select("user", F.ceil(F.col("n_tags") / most).cast("int").alias("n_pages"))
    many = pages.where("n_pages > 1")
    paged = skew_join(tags, many, "user", ["tag"], "left").withColumn(
        "page", F.pmod(F.xxhash64("tag"), F.coalesce("n_pages", F.lit(1))).cast("bigint")
    )
    return paged.groupBy("user", "page").agg(
        F.array_join(F.sort_array(F.collect_list("tag")), "; ").alias("descriptions"),
        F.count(F.lit(1)).alias("n_tags"),
    )


def answers_by_count(
    answers: DataFrame, counts: list[int], max_length: int, uncapped_up_to: int
) -> DataFrame:
    """For each question and each K: its first K non-null answers, cleaned, joined by line breaks.

    ``max_length`` applies to K above ``uncapped_up_to``. Only the first ``max(counts)`` answers of a
    question are gathered; intent and reference come from its first row. The whole answer list stays
    in the input; ``n_answers`` tells its length.
    """
    facts = answers.groupBy("question").agg(
        F.min_by("intent", "ord").alias("intent"),
        F.min_by("reference_answer", "ord").alias("reference_answer"),
        F.count("response").alias("n_answers"),
    )
    first = (
        top_k(answers.where(F.col("response").isNotNull()).select("question", "ord", "response"),
              ["question"], ["ord"], max(counts))
        .groupBy("question").agg(in_order("rank", "response").alias("answers"))
    )
    per_count = (
        facts.join(first, "question", "left")
        .withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts])))
    )
    limit = F.when(F.col("k") <= uncapped_up_to, 0).otherwise(max_length)
    cleaned = F.transform(F.slice("answers", 1, F.col("k")), lambda a: summary_answer(a, limit))
    return per_count.select(
        "question", "intent", "reference_answer", "n_answers", F.col("k").cast("bigint").alias("k"),
        cleaned.alias("answers"),
    )
