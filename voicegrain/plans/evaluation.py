"""Evaluation runs: a record for every row, and all metrics from these records at once.

Replies are parsed once. The records (what was asked and said, the prediction and the normalised target) are kept on reliable
storage, and one aggregate with ``GROUPING SETS`` gives the metrics of all rows and of each group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.functions import replies
from voicegrain.operators import inference, metrics
from voicegrain.operators.once import compute_once
from voicegrain.session import checkpoint
from voicegrain.sources.tables import ranking_columns

c = F.col


@dataclass(frozen=True)
class Evaluation:
    """``records`` holds the rows given and what was read from them; ``metrics`` a row for each group and, where
    ``is_total``, one over all records, whose group is null."""

    records: DataFrame
    metrics: DataFrame


def right(prediction: Column, target: Column) -> Column:
    """Whether a valid prediction is the target; null without one."""
    return F.when(prediction.isNotNull(), prediction == F.coalesce(target, F.lit("")))


def yes_no(rows: DataFrame, by: list[str] = ()) -> Evaluation:
    """Of ``answer, response``: ``prediction`` (YES, NO or null), ``target`` and ``is_right``."""
    read = compute_once(rows, "prediction", replies.yes_no(c("response")))
    read = read.withColumn("target", replies.yes_no_target(c("answer"))).withColumn("is_right", right(c("prediction"), c("target")))
    records = checkpoint(read)
    return Evaluation(records, metrics.yes_no_metrics(records, "prediction", "target", by, total=True))


def lists(rows: DataFrame, by: list[str] = ()) -> Evaluation:
    """Of ``target, response``: the ``items`` of the list said, null where there is none, and ``place`` of the target (0: not there)."""
    read = compute_once(rows, "items", replies.list_reply(c("response")))
    records = checkpoint(read.withColumn("place", F.array_position("items", c("target"))))
    return Evaluation(records, metrics.list_metrics(records, "items", "target", "response", by, total=True))


def ratings(rows: DataFrame, by: list[str] = ()) -> Evaluation:
    """Of ``target, response``: ``stars`` and ``confidence``, null unless both parse, and ``error``."""
    read = with_rating(rows).withColumn("error", F.abs(c("target") - c("stars")))
    records = checkpoint(read)
    return Evaluation(records, metrics.rating_metrics(records, "stars", "confidence", "target", by, total=True))


def with_rating(rows: DataFrame) -> DataFrame:
    """Adds ``stars, confidence``, parsed once however often they are used."""
    stars, share = replies.rating(c("response"))
    read = compute_once(rows, "_rating", F.struct(stars.alias("stars"), share.alias("confidence")))
    return read.withColumns({"stars": c("_rating.stars"), "confidence": c("_rating.confidence")}).drop("_rating")


def rounds(rows: DataFrame, make_model, n: int = 10, by: list[str] = (), **options) -> Evaluation:
    """Recommendations round by round: records have ``recommendations`` and, of every round, ``prompts`` and ``responses``.
    Candidates may be a list literal."""
    rows = ranking_columns(rows)
    if rows.schema["candidates"].dataType.typeName() == "string":
        rows = rows.withColumn("candidates", replies.string_list(c("candidates")))
    records = checkpoint(inference.recommend_in_rounds(rows, make_model, n, **options))
    return Evaluation(records, metrics.iterative_metrics(records, "recommendations", "target", by, total=True))
