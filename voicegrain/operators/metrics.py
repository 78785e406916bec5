"""Metrics over stored replies. Every ratio is 0.0 when its denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def aggregated(df: DataFrame, by: list[str], total: bool, *columns: Column) -> DataFrame:
    """One aggregate by ``by``; with ``total`` also over all rows, in one pass, marked by ``is_total``."""
    if not total:
        return df.groupBy(*by).agg(*columns)
    if not by:
        return df.agg(*columns).withColumn("is_total", F.lit(True))
    keys = [F.col(name) for name in by]
    return df.groupingSets([keys, []], *keys).agg(*columns, (F.grouping_id() > 0).alias("is_total"))


def yes_no_metrics(df: DataFrame, predicted: str, target: str, by: list[str] = (), total: bool = False) -> DataFrame:
    """Confusion counts and rates for YES. A wrong YES is a false positive and a wrong NO a false
    negative, whatever the target says."""
    said, right = F.col(predicted), F.col(predicted) == F.coalesce(F.col(target), F.lit(""))
    counts = aggregated(
        df, by, total,
        F.count(F.lit(1)).alias("num_samples"),
        F.count(said).alias("_valid"),
        F.count_if((said == "YES") & right).alias("true_positives"),
        F.count_if((said == "YES") & ~right).alias("false_positives"),
        F.count_if((said == "NO") & right).alias("true_negatives"),
        F.count_if((said == "NO") & ~right).alias("false_negatives"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumns({
            "accuracy": ratio(tp + tn, F.col("_valid")),
            "valid_response_rate": ratio(F.col("_valid"), F.col("num_samples")),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        })
        .withColumn("f1_score", ratio(2 * p * r, p + r))
        .drop("_valid")
    )


def hit(items: Column, target: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(items, 1, k), target), F.lit(False)).cast("int")


def list_metrics(
    df: DataFrame, items: str, target: str, reply: str, by: list[str] = (), total: bool = False, **more: Column
) -> DataFrame:
    """Hit rates over rows whose list parsed, the share of such rows, the mean reply length, and ``more`` aggregates."""
    parsed = F.col(items).isNotNull()
    rates = {
        f"hit_rate_at_top_{k}": F.coalesce(F.avg(F.when(parsed, hit(F.col(items), F.col(target), k))), F.lit(0.0))
        for k in (5, 10)
    }
    return aggregated(
        df, by, total,
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(F.length(reply)).alias("avg_response_length"),
        *[column.alias(name) for name, column in rates.items()],
        F.avg(parsed.cast("int")).alias("valid_response_rate"),
        *[column.alias(name) for name, column in more.items()],
    )


def iterative_metrics(df: DataFrame, items: str, target: str, by: list[str] = (), total: bool = False) -> DataFrame:
    """Hit rates and mean number of recommendations over all rows."""
    return aggregated(
        df, by, total,
        F.count(F.lit(1)).alias("num_samples"),
        *[F.avg(hit(F.col(items), F.col(target), k)).alias(f"hit_rate_at_top_{k}") for k in (5, 10)],
        F.avg(F.size(items)).alias("avg_recommendations_per_sample"),
    )


def rating_metrics(
    df: DataFrame, stars: str, confidence: str, target: str, by: list[str] = (), total: bool = False
) -> DataFrame:
    """Mean absolute rating error, and the same weighted by confidence, over rows that parsed."""
    error = F.abs(F.col(target) - F.col(stars))
    return aggregated(
        df, by, total,
        F.count(F.lit(1)).alias("num_samples"), F.count(F.col(stars)).alias("num_valid"),
        F.avg(error).alias("average_prediction_error"),
        ratio(F.sum(error * F.col(confidence)), F.sum(F.when(F.col(stars).isNotNull(), F.col(confidence))))
        .alias("weighted_average_prediction_error"),
    )


def accuracy_by(df: DataFrame, predicted: Column, truth: Column, by: list[str] = ()) -> DataFrame:
    """Rows, rows with a prediction, right ones, and accuracy over the rows with a prediction."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"), F.count(predicted).alias("num_valid"),
        F.count_if(predicted == truth).alias("num_correct"),
    ).withColumn("accuracy", ratio(F.col("num_correct"), F.col("num_valid")))


def judge_means(df: DataFrame, score: str, by: list[str], detail: str) -> DataFrame:
    """Mean score per ``by`` and ``detail``, and over all details as ``Avg.``."""
    means = df.rollup(*by, detail).agg(
        F.avg(score).alias("mean_score"), F.count(score).alias("n_scored"),
        F.grouping_id().alias("_level"),
    )
    return (
        means.where(F.col("_level") <= 1)
        .withColumn(detail, F.when(F.col("_level") == 1, "Avg.").otherwise(F.col(detail)))
        .drop("_level")
    )


def flag_best(scores: DataFrame, score: str, within: list[str]) -> DataFrame:
    """``is_best`` marks the highest score within each group; ties share the mark."""
    best = scores.groupBy(*within).agg(F.max(score).alias("_best"))
    return scores.join(best, within).withColumn("is_best", F.col(score) == F.col("_best")).drop("_best")
