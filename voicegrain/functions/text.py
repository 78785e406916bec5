"""Text expressions: template fill, numbered lists, item display strings, prompt formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voicegrain.lookups import ATTRIBUTE_LABELS

# Unicode white space plus the four ASCII separators, at either end of a text
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    """Remove all white space (not only blanks) at both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fill_template(template, *fields) -> Column:
    """Replace literal tokens one after another; ``fields`` is a run of (token, value).

    The order matters: a value that itself holds a later token is filled too.
    """
    out = as_column(template)
    for token, value in fields:
        out = F.replace(out, F.lit(token), as_column(value))
    return out


def numbered(items: Column, before: str = "(", after: str = ") ", joint: str = "\n", end: str = "") -> Column:
    """``(1) a``, ``(2) b`` ... as one string; ``before``/``after`` surround the number."""
    lines = F.transform(
        items, lambda item, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), item, F.lit(end))
    )
    return F.array_join(lines, joint)


def readable_label(attribute: str) -> str:
    return ATTRIBUTE_LABELS.get(attribute) or attribute.replace("_", " ").title()


def year_text(value: Column) -> Column:
    """A number as integer text, anything else unchanged."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def item_display(attributes: list[str]) -> Column:
    """One attribute as it is, several as ``Label: value, Label: value`` without nulls."""
    if len(attributes) == 1:
        return F.col(attributes[0]).cast("string")
    parts = []
    for name in attributes:
        value = year_text(F.col(name)) if name == "year" else F.col(name).cast("string")
        parts.append(F.concat(F.lit(readable_label(name) + ": "), value))
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def chat_message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column, use_system_prompt: bool = True) -> Column:
    """Split a prompt into system and user messages at the first marker that works,
    else at the first line break, else keep one user message."""
    whole = F.array(chat_message("user", prompt))
    if not use_system_prompt:
        return whole

    def halves(position: Column) -> tuple[Column, Column]:
        return strip(F.substring(prompt, F.lit(1), position - 1)), strip(F.substring(prompt, position + 1, F.length(prompt)))

    out = None
    # Where a prompt's instruction ends
    for marker, least in (("\nUser Profile:", 2), ("\nQuestion:", 2), ("\n", 1)):
        position = F.locate(marker, prompt)
        system, user = halves(position)
        usable = (position >= least) & (system != "") & (user != "")
        pair = F.array(chat_message("system", system), chat_message("user", user))
        out = F.when(usable, pair) if out is None else out.when(usable, pair)
    return out.otherwise(whole)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def completion_prompt(system_prompt: Column, question: Column, model_name: str = "") -> Column:
    """``system\\n\\nquestion`` and a suffix that depends on the model family."""
    # Families whose tokenizers need a line break at the boundary
    suffix = "\n\n" if any(family in model_name.lower() for family in ("gemma", "olmo")) else " "
    system = F.when(blank_to_null(system_prompt).isNotNull(), strip(system_prompt))
    return F.concat(F.concat_ws("\n\n", system, strip(question)), F.lit(suffix))


def sft_messages(system_prompt: Column, question: Column, answer: Column) -> Column:
    """Optional system message, then the user and assistant messages."""
    system = F.when(blank_to_null(system_prompt).isNotNull(), chat_message("system", system_prompt))
    return F.array_compact(F.array(system, chat_message("user", question), chat_message("assistant", answer)))


# What a published profile must not contain, most specific first
SCRUB_PATTERNS = [
    ("url", r"https?://[^\s]+|www\.[^\s]+", "[URL]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "[EMAIL]"),
    ("phone", r"\+?[0-9][0-9() .-]{7,}[0-9]", "[PHONE]"),
    ("handle", r"@[A-Za-z0-9_.]+", "[HANDLE]"),
]
