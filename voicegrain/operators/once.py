"""Evaluating costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column that later steps may use many times without evaluating it again.

    The optimizer copies a projected expression into every filter and column built on it. It does not
    look into a generator, so a one-element explode of the projected column keeps the value, and the
    generated code small.
    """
    return df.withColumn("_once", expression).select(*df.columns, F.explode(F.array("_once")).alias(name))
