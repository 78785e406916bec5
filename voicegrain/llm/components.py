"""Connected components by alternating large and small stars, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import stored
from voicegrain.operators.skew import skew_join


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node ``a`` on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
    seen = skew_join(both, least, "a", ["b"])
    if large:
        found = seen.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        found = seen.select(F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(
            least.select("a", F.col("_low").alias("b"))
        )
    return found.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node of its component.

    No edges, no rows; loops and repeats do no harm.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        now = stored(_stars(stored(_stars(now, True)), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
