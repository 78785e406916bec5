"""Texts without addresses and numbers that a published table must not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrain.functions.text import SCRUB_PATTERNS
from voicegrain.operators.once import compute_once


def scrub(df: DataFrame, text: str, out: str = "scrubbed") -> DataFrame:
    """Adds ``out``, the text with URLs, e-mail addresses, phone numbers and handles replaced, and the number of each kind.

    Kinds are replaced one after the other, each once a row: a later kind sees the marks of earlier ones.
    """
    df = df.withColumn(out, F.col(text))
    for kind, pattern, mark in SCRUB_PATTERNS:
        counted = df.withColumn(f"n_{kind}", F.regexp_count(out, F.lit(pattern)).cast("bigint"))
        df = compute_once(counted, "_next", F.regexp_replace(out, pattern, mark)).drop(out).withColumnRenamed("_next", out)
    return df
