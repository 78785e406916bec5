"""Expressions over model replies: labels, lists, ratings, items, scores, budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voicegrain.functions.text import strip
from voicegrain.lookups import ANALYSIS_MARKER, FINAL_MARKER, OVERALL_SCORE_KEYS, THINK_END

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """Decimal text to double; null for anything else."""
    text = strip(text)
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def final_channel(reply: Column) -> Column:
    """Text after the last final-channel marker, or the whole text."""
    return F.substring_index(reply, FINAL_MARKER, -1)


def after_analysis(reply: Column) -> Column:
    """Text after the last analysis marker, stripped where the marker occurs."""
    found = F.contains(F.lower(reply), F.lit(ANALYSIS_MARKER))
    return F.when(found, strip(F.substring_index(reply, ANALYSIS_MARKER, -1))).otherwise(reply)


def summary_answer(reply: Column, max_length: Column) -> Column:
    """Answer text for an aggregation prompt: '' for null, cut to ``max_length`` when that is positive."""
    text = F.coalesce(strip(after_analysis(reply)), F.lit(""))
    cut = (max_length > 0) & (F.length(text) > max_length)
    return F.when(cut, F.concat(F.substring(text, F.lit(1), max_length), F.lit("..."))).otherwise(text)


def without_thinking(reply: Column) -> Column:
    """Text between the first and the second end-of-thinking tag, or the whole text."""
    return F.when(F.contains(reply, F.lit(THINK_END)), F.split_part(reply, F.lit(THINK_END), F.lit(2))).otherwise(reply)


def yes_no(reply: Column) -> Column:
    """YES or NO when the reply is or holds exactly one of them, else null.

    NO also counts inside words such as KNOW.
    """
    text = F.upper(strip(without_thinking(reply)))
    has_yes, has_no = F.contains(text, F.lit("YES")), F.contains(text, F.lit("NO"))
    return F.when(has_yes & ~has_no, "YES").when(has_no & ~has_yes, "NO")


def yes_no_target(target: Column) -> Column:
    """YES before NO by containment, else the upper-cased text."""
    text = F.upper(strip(target.cast("string")))
    return (
        F.when(F.contains(text, F.lit("YES")), "YES").when(F.contains(text, F.lit("NO")), "NO").otherwise(text)
    )


def match_item(reply: Column, candidates: Column) -> Column:
    """First candidate equal to the reply, else inside it, else containing it; case does not matter.

    An empty reply is inside every candidate, so it matches the first one.
    """
    said = F.lower(strip(without_thinking(reply)))

    def first(test) -> Column:
        return F.try_element_at(F.filter(candidates, test), F.lit(1))

    return F.coalesce(
        first(lambda c: F.lower(c) == said),
        first(lambda c: F.contains(said, F.lower(c))),
        first(lambda c: F.contains(F.lower(c), said)),
    )


def remove_first(items: Column, item: Column) -> Column:
    """Drop the first occurrence only."""
    position = F.array_position(items, item)
    return F.filter(items, lambda _, i: i + 1 != position)


def string_list(text: Column) -> Column:
    """List literal with single or double quotes to an array; a comma before the bracket is allowed."""
    tidy = F.regexp_replace(text, r",\s*\]\s*$", "]")
    return F.from_json(tidy, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})


def list_reply(reply: Column) -> Column:
    """First bracketed list of the final channel, or null when there is none or it does not parse."""
    text = final_channel(F.replace(reply, F.lit(">"), F.lit("")))
    bracketed = F.contains(text, F.lit("[")) & F.contains(text, F.lit("]"))
    inside = F.split_part(F.split_part(text, F.lit("["), F.lit(2)), F.lit("]"), F.lit(1))
    return F.when(bracketed, string_list(F.concat(F.lit("["), inside, F.lit("]"))))


def rating(reply: Column) -> tuple[Column, Column]:
    """(stars, confidence) of a reply such as ``(4 stars, 80%)``; both null unless both parse."""
    final = final_channel(reply)
    marked = F.contains(reply, F.lit(FINAL_MARKER))
    paired = F.contains(final, F.lit("(")) & F.contains(final, F.lit(")"))
    body = (
        F.when(marked & paired, F.split_part(final, F.lit("("), F.lit(2)))
        .when(marked, final)
        .when(paired, F.substring_index(reply, "(", -1))
    )
    body = F.regexp_replace(strip(body), r"^[()]+|[()]+$", "")
    parts = F.split(body, ",")
    stars = number(F.replace(F.replace(parts[0], F.lit("stars"), F.lit("")), F.lit("star"), F.lit("")))
    share = number(F.replace(F.try_element_at(parts, F.lit(2)), F.lit("%"), F.lit("")))
    good = (F.size(parts) == 2) & stars.isNotNull() & share.isNotNull()
    return F.when(good, stars), F.when(good, share)


_QUOTE = "['\"’‘“”]"


def judge_scores(reply: Column) -> Column:
    """Map of dimension to score from the reply's last braces; scores outside 1..10 are dropped."""
    tail = F.substring_index(reply, "{", -1)
    pair = F.lit(f"{_QUOTE}([^'\"’‘“”]+){_QUOTE}\\s*[:：]\\s*([0-9]+)")
    names, values = F.regexp_extract_all(tail, pair, 1), F.regexp_extract_all(tail, pair, 2)
    entries = F.aggregate(
        F.arrays_zip(names.alias("name"), values.alias("score")),
        F.create_map().cast("map<string,int>"),
        lambda seen, e: F.map_concat(  # a name given twice keeps its last score
            F.map_filter(seen, lambda name, _: name != e["name"]),
            F.create_map(e["name"], e["score"].try_cast("int")),
        ),
    )
    return F.map_filter(entries, lambda _, score: score.between(1, 10))


def overall_score(scores: Column) -> Column:
    return F.coalesce(*[F.try_element_at(scores, F.lit(key)) for key in OVERALL_SCORE_KEYS])


def generation_budget(max_tokens: Column, context: Column) -> Column:
    """Tokens reserved for the reply; a request as large as the context falls back to an eighth of it."""
    guard = F.least(F.lit(4096), F.greatest(F.lit(256), F.floor(context / 8)))
    return F.when(max_tokens >= context, guard).otherwise(F.least(max_tokens, F.greatest(F.lit(1), context - 1)))


def allowed_input(max_tokens: Column, context: Column) -> Column:
    return F.greatest(F.lit(1), context - generation_budget(max_tokens, context))


def estimated_tokens(prompt: Column) -> Column:
    """Default length function: four characters to a token."""
    return F.ceil(F.length(prompt) / 4)


def too_long_reply(tokens: Column, allowed: Column) -> Column:
    return F.concat(
        F.lit("[SKIPPED: Prompt too long for configured context window (prompt_tokens="),
        tokens.cast("string"), F.lit(", allowed_input_tokens="), allowed.cast("string"), F.lit(")]"),
    )


def label_text(value: Column, kind: Column) -> Column:
    """YES/NO for booleans, else the stripped upper-cased text; ``kind`` is the JSON type."""
    return F.when(kind == "BOOLEAN", F.when(value == "true", "YES").otherwise("NO")).otherwise(F.upper(strip(value)))


def counts_list(text: str | int) -> list[int]:
    """``"1-5-10"`` to [1, 5, 10]; a single number to a list of one."""
    return [int(part) for part in str(text).split("-")]
