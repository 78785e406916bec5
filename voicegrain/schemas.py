"""Declared schemas and the column checks applied when a table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

POSTS_RAW = "author string, text string"
DESCRIPTIONS = "User string, UserInformation string"
USEFUL_LABELS = "User string, Tweet string, Prompt string, Response string"
PROFILES = "user_id string, user_profile string"
QUESTIONS = "question string, reference_ans string, user_intent string, language string"
INTEREST = "user_name string, user_profile string, item_description string, dataset string, prompt string, response string"
ANNOTATION = "question string, user_profile string"
ANSWERS = "question string, reference_answer string, intent string, user_profile string, prompt string, Response string"
FINETUNED = "question string, intent string, reference_answer string, user_profile string, system_prompt string"
PROFILE_QA = "`User Name` string, `User Profile` string, Question string, Answer string"
SFT = "question string, answer string, system_prompt string"
RANKING = "target string, candidates string, interaction_history string"
FEW_ZERO = "prompt string, target string, few_zero string, task string"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail early when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def rename_if_absent(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename ``old`` to ``new`` where the table has ``old`` and not ``new``."""
    wanted = {old: new for old, new in names.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(wanted)


def alias_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Copy ``old`` to ``new`` where the table has ``old``; ``old`` stays."""
    return df.withColumns({new: F.col(f"`{old}`") for old, new in names.items() if old in df.columns})


def normalise_profiles(df: DataFrame) -> DataFrame:
    """Accept both profile schemas; the result always has ``user_id, user_profile``."""
    df = rename_if_absent(df, {"UserName": "user_id", "UserProfile": "user_profile"})
    return require_columns(df, ["user_id", "user_profile"])
