"""Interest replies to supervised fine-tuning rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrain.functions.json_replies import in_last_braces
from voicegrain.functions.replies import label_text
from voicegrain.functions.text import blank_to_null, completion_prompt, fill_template, numbered, sft_messages, strip
from voicegrain.operators.batching import in_order
from voicegrain.operators.once import compute_once
from voicegrain.operators.parsing import parse_by
from voicegrain.operators.ranking import hash_number, key_hash, top_k
from voicegrain.session import checkpoint

# Default labels
ACCEPTED = ["YES", "NO", "MAYBE"]
POSITIVE, NEGATIVE = "YES", "NO"


def clean_interest(replies: DataFrame, accepted: list[str] = ACCEPTED) -> DataFrame:
    """Parsed replies with an accepted label and a justification."""
    labels = [label.strip().upper() for label in accepted]
    parsed = parse_by(replies, in_last_braces, ["Justification", "IsInterested"])
    label = label_text(F.col("parsed.IsInterested"), F.col("parsed.kinds.IsInterested"))
    named = compute_once(parsed, "is_interested", label)
    return (
        named.where(F.col("is_interested").isin(*labels) & F.col("parsed.Justification").isNotNull())
        .withColumn("justification", F.col("parsed.Justification"))
        .drop("parsed")
    )


def build_pairs(
    cleaned: DataFrame, row_key: list[str], bounds: tuple[int, int], dataset: str, variant: str,
    system_prompt: str, template: str, seed, positive: str = POSITIVE, negative: str = NEGATIVE,
) -> DataFrame:
    """Two rows per eligible user: one positive and one negative candidate behind the same history.

    A user is eligible with at least ``low + 1`` positives and one negative. The history length is
    uniform in ``low .. min(high, positives - 1)``. Positives are taken in hash order: the first is the
    candidate, the next ones the history, so at most ``high + 1`` rows of a user are ever gathered.
    """
    low, high = bounds
    labelled = checkpoint(cleaned.where(F.col("is_interested").isin(positive, negative)).select(
        "user_name", "item_description", "is_interested", key_hash(seed, *row_key).alias("_hash")
    ))  # read for counts and for histories; the replies behind it are read once
    is_yes, is_no = F.col("is_interested") == positive, F.col("is_interested") == negative
    users = (
        labelled.groupBy("user_name").agg(
            F.count_if(is_yes).alias("n_yes"), F.count_if(is_no).alias("n_no"),
            F.min_by(F.when(is_no, F.col("item_description")), F.when(is_no, F.col("_hash"))).alias("negative_item"),
        )
        .where((F.col("n_yes") - 1 >= low) & (F.col("n_no") > 0))
        .withColumn("_span", F.least(F.lit(high), F.col("n_yes") - 1) - low + 1)
        .withColumn("history_length", F.lit(low) + hash_number(f"{seed}-length", "user_name") % F.col("_span"))
    )
    firsts = (
        top_k(labelled.where(is_yes), ["user_name"], ["_hash"], high + 1)
        .groupBy("user_name").agg(in_order("rank", "item_description").alias("_items"))
    )
    rows = users.join(firsts, "user_name").select(
        F.col("user_name").alias("user_id"), F.lit(dataset).alias("dataset"), F.lit(variant).alias("source_variant"),
        F.col("history_length").cast("bigint").alias("history_length"),
        F.slice("_items", F.lit(2), F.col("history_length").cast("int")).alias("_history"),
        F.explode(F.array(
            F.struct(F.element_at("_items", 1).alias("item"), F.lit(positive).alias("answer")),
            F.struct(F.col("negative_item").alias("item"), F.lit(negative).alias("answer")),
        )).alias("_pair"),
    )
    return rows.select(
        "user_id", "dataset", "source_variant", "history_length", F.col("_pair.item").alias("candidate_item"),
        fill_template(template, ("{history}", numbered(F.col("_history"))), ("{candidate}", F.col("_pair.item")))
        .alias("question"),
        F.col("_pair.answer").alias("answer"), F.lit(system_prompt).alias("system_prompt"),
    )


def filled_rows(sft: DataFrame) -> DataFrame:
    """Drop rows with an empty question or answer; white space alone is kept."""
    return sft.where(blank_to_null(F.col("question")).isNotNull() & blank_to_null(F.col("answer")).isNotNull())


def format_completion(sft: DataFrame, model_name: str = "") -> DataFrame:
    """Adds ``prompt`` and ``completion``."""
    return sft.withColumns({
        "prompt": completion_prompt(F.col("system_prompt"), F.col("question"), model_name),
        "completion": strip(F.col("answer")),
    })


def format_messages(sft: DataFrame) -> DataFrame:
    """Adds the chat ``messages``."""
    return sft.withColumn("messages", sft_messages(F.col("system_prompt"), F.col("question"), F.col("answer")))
