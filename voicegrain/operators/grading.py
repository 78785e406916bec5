"""Rubric lookup and grading prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrain.functions.text import fill_template
from voicegrain.lookups import RUBRIC_DIMENSIONS
from voicegrain.operators.skew import lookup_join


def rubric_text(intent: str, dimensions: list[str]) -> str:
    """Default grading instructions, made from the dimension names."""
    listed = "\n".join(f"{i}. {name}" for i, name in enumerate(dimensions, 1))
    shape = ", ".join(f"'{name}': n" for name in dimensions)
    return (
        f"Grade the answer to a question of type {intent} on these dimensions, each from 1 to 10:\n{listed}\n"
        "Explain each grade first. Length alone earns nothing. Factuality and satisfaction weigh most.\n"
        f"End with one line of whole numbers: {{{shape}, 'Overall': n}}"
    )


def rubrics(spark: SparkSession) -> DataFrame:
    """One row per intent: ``intent, dimensions, rubric``. Callers may pass a table of their own."""
    rows = [(intent, names, rubric_text(intent, names)) for intent, names in RUBRIC_DIMENSIONS.items()]
    return spark.createDataFrame(rows, "intent string, dimensions array<string>, rubric string")


def with_rubric(rows: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """Add each row's rubric by its intent. An unknown intent drops the row, or with ``strict`` fails the job.

    The table has one row per intent, seven by default; of repeated ones the first by text counts. It is broadcast
    only if it is small.
    """
    known = table.groupBy("intent").agg(F.min("rubric").alias("rubric"))
    joined = lookup_join(rows, known, "intent", "left" if strict else "inner")
    if not strict:
        return joined
    message = F.concat(F.lit("no rubric for intent "), F.coalesce(F.col("intent"), F.lit("null")))
    return joined.withColumn("rubric", F.when(F.col("rubric").isNull(), F.raise_error(message)).otherwise(F.col("rubric")))


def grading_prompt(template: str, with_profile: bool):
    """Prompt expression over ``rubric, question, response`` and ``user_profile`` or ``reference_answer``."""
    last = ("TEMPLATE_USER_PROFILE", F.col("user_profile")) if with_profile else (
        "TEMPLATE_GPT4_ANSWER", F.col("reference_answer"))
    return fill_template(
        template, ("TEMPLATE_GRADING_CRITERIA", F.col("rubric")), ("TEMPLATE_QUESTION", F.col("question")),
        ("TEMPLATE_TEST_ANSWER", F.col("response")), last,
    )
