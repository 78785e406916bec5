"""Profiles nearest to a question by cosine similarity, exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voicegrain.operators.ranking import top_k

# Vectors of one task: these many questions times these many profiles. Equal sides repeat the fewest vectors.
QUESTION_BLOCK = 8192
PROFILE_BLOCK = 8192

# Cosines that a Python worker holds at once (16 MB), and tasks that blocks are dealt to at most.
CELLS = 1 << 21
MOST_TASKS = 4096

# Similarities are rounded so that copies of a vector tie and the lower id wins.
DECIMALS = 9


def nearest_profiles(
    questions: DataFrame, profiles: DataFrame, k: int,
    question_block: int = QUESTION_BLOCK, profile_block: int = PROFILE_BLOCK,
) -> DataFrame:
    """For each question its ``k`` profiles with the highest cosine: ``question_id, profile_id, similarity, rank``.

    ``questions`` has ``question_id, vector``; ``profiles`` has ``profile_id, vector``. Both sides are
    cut into blocks of bounded size by the hash of their unique id. A task multiplies one block of
    each, a few questions at a time, and keeps the best ``k`` per question, so only those are shuffled to the final
    ranking. Pairs of blocks are dealt to as many tasks, as their work is the product and not the bytes.
    """
    question_blocks = max(1, -(-questions.count() // question_block))
    profile_blocks = max(1, -(-profiles.count() // profile_block))
    tasks = min(question_blocks * profile_blocks, MOST_TASKS)

    def placed(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            key, "vector", F.pmod(F.xxhash64(key), F.lit(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))).alias(other),
        ).repartition(tasks, "_q", "_p")

    left = placed(questions, "question_id", "_q", question_blocks, "_p", profile_blocks)
    right = placed(profiles, "profile_id", "_p", profile_blocks, "_q", question_blocks)
    schema = StructType([
        StructField("question_id", questions.schema["question_id"].dataType),
        StructField("profile_id", profiles.schema["profile_id"].dataType),
        StructField("similarity", DoubleType()),
    ])

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return best_in_block(asked, known, k)

    found = left.groupBy("_q", "_p").cogroup(right.groupBy("_q", "_p")).applyInPandas(best, schema)
    return top_k(found, ["question_id"], [F.desc("similarity"), "profile_id"], k, slices=1)


def best_in_block(asked: pd.DataFrame, known: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of a block's profiles for each of a block's questions, ties by profile id."""
    if asked.empty or known.empty:
        return pd.DataFrame({"question_id": [], "profile_id": [], "similarity": []})
    known = known.sort_values("profile_id")
    profiles, k = unit_rows(known["vector"]).T, min(k, len(known))
    step, columns, similarities = max(1, CELLS // len(known)), [], []
    for at in range(0, len(asked), step):
        column, similarity = lowest_in_rows(-unit_rows(asked["vector"].iloc[at:at + step]) @ profiles, k)
        columns.append(column)
        similarities.append(similarity)
    return pd.DataFrame({
        "question_id": np.repeat(asked["question_id"].to_numpy(), k),
        "profile_id": known["profile_id"].to_numpy()[np.concatenate(columns)],
        "similarity": np.concatenate(similarities),
    })


def lowest_in_rows(negative: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rounded cosines of the ``k`` lowest negative cosines of each row, in order, ties by column; NaN comes last.

    Only what may be among them after rounding is rounded and sorted.
    """
    limit = np.partition(negative, k - 1, axis=1)[:, k - 1, None] + 2 * 10.0**-DECIMALS
    row, column = np.nonzero(~(negative > limit))
    similarity = np.round(-negative[row, column], DECIMALS) + 0.0
    order = np.lexsort((-similarity, row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return column[order], similarity[order]


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)
