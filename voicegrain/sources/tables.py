"""Readers. Every reader declares its schema, checks its columns and, where "the first N" matters,
adds a file-order ordinal."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voicegrain import schemas
from voicegrain.functions.text import item_display
from voicegrain.lookups import DATASET_ATTRIBUTES, DEFAULT_ATTRIBUTES
from voicegrain.sources.quoted_csv import read_records


def with_file_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add a dense ordinal that follows file name, then position in the file.

    Splits of a file are read in any order, so each row's place in its split is added to the number
    of rows in earlier splits, which are counted without reading a column. The running sum sees one row per split, and
    no job runs before the result is asked for. ``df`` must come straight from a file reader: a filter before this would
    change the ordinals.
    """
    columns = df.columns
    file, block = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        df.select(file, block, F.monotonically_increasing_id().alias("_row"))
        .groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
        .select("_file", "_block", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    placed = df.select("*", file, block, F.monotonically_increasing_id().alias("_row"))
    return placed.join(splits, ["_file", "_block"]).select(
        *columns, (F.col("_row") + F.col("_shift")).cast("bigint").alias(name))


def with_row_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """As ``with_file_order`` for parquet, whose files know each row's place; only rows per file are counted."""
    columns = df.columns
    file = F.col("_metadata.file_path").alias("_file")
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.select(file).groupBy("_file").agg(F.count(F.lit(1)).alias("_size")).select(
        "_file", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    placed = df.select("*", file, F.col("_metadata.row_index").alias("_row"))
    return placed.join(starts, "_file").select(*columns, (F.col("_row") + F.col("_start")).cast("bigint").alias(name))


def post_columns(df: DataFrame) -> DataFrame:
    """``author`` and ``text`` become ``user`` and ``tweet`` unless these exist already."""
    return schemas.require_columns(
        schemas.rename_if_absent(df, {"author": "user", "text": "tweet"}), ["user", "tweet"]
    )


def read_posts_json(spark: SparkSession, folder: str, schema: str = schemas.POSTS_RAW) -> DataFrame:
    """``user, tweet, ord, post_id``: posts in file order, numbered over all files."""
    return with_post_id(with_file_order(post_columns(spark.read.schema(schema).json(os.path.join(folder, "*.jsonl")))))


def with_post_id(posts: DataFrame) -> DataFrame:
    """The ordinal as ``post_id``, unless the posts bring their own."""
    return posts if "post_id" in posts.columns else posts.withColumn("post_id", F.col("ord"))


def read_posts_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return with_post_id(with_row_order(post_columns(spark.read.parquet(os.path.join(folder, "*.parquet")))))


def copy_post_columns(df: DataFrame) -> DataFrame:
    """``user`` and ``tweet`` as copies; ``author`` and ``text`` stay."""
    return schemas.alias_columns(df, {"author": "user", "text": "tweet"})


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """CSV with a header and quoted fields that hold line breaks and doubled quotes, read in splits.

    ``required`` columns are checked and only they are kept, by the names in the header of the first file; with ``order``
    also the records' dense ordinal, by file name and place.
    """
    found = header_of(spark, path)
    if required is None:
        required = [f.name for f in spark.createDataFrame([], schema).schema.fields] if schema else found
    rows = schemas.require_columns(read_records(spark, path, found), required)
    return rows.select(*[F.col(f"`{c}`") for c in required], *([F.col("_ord").alias(order)] if order else []))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first record of the first file; Spark reads no more of it."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_interest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, required=["user_name", "item_description", "response"], order="ord")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return schemas.normalise_profiles(read_csv(spark, path, order="ord")).select("ord", "user_id", "user_profile")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions in file order; ``ord`` and ``position`` are the same number."""
    return read_csv(spark, path, schema=schemas.QUESTIONS, order="ord").withColumn("position", F.col("ord"))


def item_pool(items: DataFrame, dataset: str) -> DataFrame:
    """The display string of every item; items without one are dropped."""
    attributes = DATASET_ATTRIBUTES.get(dataset, DEFAULT_ATTRIBUTES)
    schemas.require_columns(items, attributes)
    return items.withColumn("item_description", item_display(attributes)).na.drop(subset=["item_description"])


def read_items(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """Item catalogue of one dataset; missing or empty is an error."""
    pool = item_pool(with_row_order(spark.read.parquet(os.path.join(base, dataset, "items.parquet")), "item_id"),
                     dataset)
    if pool.isEmpty():
        raise ValueError(f"item pool of {dataset} is empty")
    return pool


def user_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"inference_results_user_([^/]*)\.csv$", 1)


def read_labelled_posts(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV per user; the file name carries the user. All files in one scan; ``ord`` counts their records by file name
    and place, so it is the same however the files are split."""
    names = [f.name for f in spark.createDataFrame([], schemas.USEFUL_LABELS).schema.fields]
    rows = read_records(spark, os.path.join(folder, "*.csv"), names)
    return with_post_id(rows.select(
        user_of_file(F.url_decode(F.col("_file"))).alias("user"), F.col("Tweet").alias("tweet"),
        F.col("Response").alias("response"), F.col("_ord").alias("ord"),
    ))


def read_few_zero(spark: SparkSession, path: str, few_zero: str, task: str) -> DataFrame:
    df = spark.read.schema(schemas.FEW_ZERO).json(path)
    return df.where((F.col("few_zero") == few_zero) & (F.col("task") == task))


def ranking_columns(df: DataFrame) -> DataFrame:
    df = schemas.alias_columns(df, {"target_interaction": "target", "candidate_pool": "candidates"})
    return schemas.require_columns(df, ["target", "candidates", "interaction_history"])


def yes_no_columns(df: DataFrame) -> DataFrame:
    """``question, answer`` are needed; ``system_prompt`` is null when absent."""
    schemas.require_columns(df, ["question", "answer"])
    return df if "system_prompt" in df.columns else df.withColumn("system_prompt", F.lit(None).cast("string"))


def constant_prompts(spark: SparkSession, prompt: str, n: int, seed: int) -> DataFrame:
    """The same prompt ``n`` times, each with its own seed."""
    ids = spark.range(n).withColumnRenamed("id", "prompt_id")
    return ids.withColumns({"prompt": F.lit(prompt), "seed": F.col("prompt_id") + seed})
