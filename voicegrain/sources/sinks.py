"""Writers: result tables, resumable reply tables, splits and metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_results(df: DataFrame, path: str, csv: bool = False) -> None:
    """Overwrite a result table as parquet; with ``csv`` also as quoted CSV (flat columns only)."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        saved = df.sparkSession.read.parquet(path)
        saved.write.mode("overwrite").option("header", True).option("escape", '"').csv(path.rstrip("/") + "_csv")


def append_replies(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def saved_replies(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """Replies already written for a run, or None before the first write."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return None
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def pending(prompts: DataFrame, done: DataFrame | None) -> DataFrame:
    """Prompts without a saved reply."""
    return prompts if done is None else prompts.join(done.select("prompt_id"), "prompt_id", "left_anti")


def write_splits(cleaned: DataFrame, sft: DataFrame, base: str) -> None:
    """The cleaned table, the full table, and its train and test parts as partitions of one table.

    ``sft`` has a ``split`` column. The split table is written once and the full table reads it back.
    """
    cleaned.write.mode("overwrite").parquet(f"{base}/cleaned_interest")
    sft.write.mode("overwrite").partitionBy("split").parquet(f"{base}/sft")


def put_metrics(metrics: DataFrame, path: str, tag: str | None = None, step: int | None = None) -> None:
    """Metric records by ``tag`` and ``step``: those given as arguments, or columns of the table.

    A tag's step is a folder of its own, and writing it again replaces what is there and nothing else, so a step that
    runs twice leaves its last records only.
    """
    given = {name: F.lit(value).cast(kind) for name, value, kind in (("tag", tag, "string"), ("step", step, "bigint")) if value is not None}
    rows = metrics.withColumns(given) if given else metrics
    rows.repartition("tag", "step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag", "step").json(path)


def metrics_history(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """A tag's records by step. ``schema`` names the metrics' columns, ``tag`` and ``step`` among them."""
    return spark.read.schema(schema).json(path).where(F.col("tag") == tag).orderBy("step")
