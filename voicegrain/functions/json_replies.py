"""Reading JSON out of noisy replies.

Replies are settled by Spark expressions where the whole text, the first fenced block, or the only pair of braces in
prose is one JSON value, JSON with commas before closing brackets, or a flat Python dict; and where it is clear that nothing
can be read. Each such text is parsed once. Only the others carry their text to a Pandas UDF, which tries every place and reader.
"""

from __future__ import annotations

import ast
import json
import math
import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from voicegrain.functions.replies import final_channel
from voicegrain.functions.text import strip
from voicegrain.lookups import ANSWER_KEYS

PARSED = StructType([StructField("json", StringType()), StructField("stage", StringType())])


# What no strict JSON text can start or end with; the test is cheaper than a parser's exception
_NOT_STRICT = r"\A\s*(?:\{\s*[^\s\"}]|[^\s{\[\"\-0-9tfn])"
_COMMA_END = r",\s*[}\]]\s*\z"
_ONE_PAIR = r"\A\s*\{[^{}]*\}\s*\z"


def maybe_strict(text: Column) -> Column:
    """The text unless its first or last characters rule out strict JSON."""
    # trimming compares character by character, so texts without white space at an end are left alone
    first, last = F.left(text, F.lit(1)).isin(*" \t\r\n"), reduce(or_, [F.endswith(text, F.lit(space)) for space in " \t\r\n"])
    ahead = F.when(first, F.ltrim(text, F.lit(" \t\r\n"))).otherwise(text)
    behind = F.when(last, F.rtrim(text, F.lit(" \t\r\n"))).otherwise(text)
    brace, bracket = F.endswith(behind, F.lit("}")), F.endswith(behind, F.lit("]"))
    closed = F.when(F.startswith(ahead, F.lit("{")), brace).when(F.startswith(ahead, F.lit("[")), bracket).otherwise(True)
    comma = (brace | bracket) & F.right(text, F.lit(40)).rlike(_COMMA_END)
    return F.when(closed & ~comma & ~text.rlike(_NOT_STRICT), text)


# A dict as Python writes it, of one level: texts in single quotes, without other quotes, escapes or control characters
_TEXT = r"'[^'\"\\\x00-\x1f]*'"
_FLAT_DICT = rf"\A\{{\s*{_TEXT}\s*:\s*VALUE(?:\s*,\s*{_TEXT}\s*:\s*VALUE)*\s*,?\s*\}}\z".replace(
    "VALUE", rf"(?:{_TEXT}|-?(?:0|[1-9][0-9]{{0,17}})|True|False|None)")
_PYTHON_NAMES = {"True": "true", "False": "false", "None": "null"}


def outside_quotes(text: Column, change) -> Column:
    """The text with ``change`` applied outside of single quotes, which become double ones."""
    parts = F.transform(F.split(text, "'"), lambda part, i: F.when(i % 2 == 0, change(part)).otherwise(part))
    return F.array_join(parts, '"')


def as_strict(piece: Column) -> Column:
    """The strict JSON text that a piece stands for: a flat Python dict or commas before closing brackets written anew,
    any other piece as it is."""
    def renamed(part: Column) -> Column:
        for name, word in _PYTHON_NAMES.items():
            part = F.replace(part, F.lit(name), F.lit(word))
        return part

    return (
        F.when(piece.rlike(_FLAT_DICT), outside_quotes(piece, renamed))
        .when(F.right(piece, F.lit(40)).rlike(_COMMA_END), F.regexp_replace(piece, r",\s*([}\]])", "$1"))
        .otherwise(piece)
    )


def unreadable(text: Column) -> Column:
    """Whether a text in one pair of braces is neither JSON nor Python: single quotes, and JSON's words outside of them."""
    words = outside_quotes(text, lambda part: F.when(part.rlike(r"\b(?:null|true|false)\b"), "\x00").otherwise(""))
    return text.rlike(r"\A\{[^{}\[\]`\"\\]*\}\z") & F.contains(text, F.lit("'")) & F.contains(words, F.lit("\x00"))


# Begins with a letter and is neither a JSON word nor has brackets or a fence: no reader finds a value in it
_ONLY_PROSE = r"\A(?!(?:true|false|null|NaN|Infinity)\s*\z)[A-Za-z][^{\[`]*\z"


def strict_json(text: Column) -> Column:
    """The variant of a text that is exactly one strict JSON value, else null.

    The parser ignores what follows a value. Nothing can follow when the only closing brace ends the
    text. Otherwise the text must survive two wrappers, which only a lone value does: behind a comma
    the list would need a value and the object a key.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(text.rlike(_ONE_PAIR), F.try_parse_json(text)).when(
        in_list.isNotNull() & in_object.isNotNull(), F.try_parse_json(text))


def unsettled(text: Column, value: Column) -> Column:
    """A bracketed text without a strict value, else null: only these can hold what Python reads and Spark does not."""
    return F.when(value.isNull() & text.rlike(r"(?s)\A\s*[{\[].*[}\]]\s*\z"), text)


def field(variant: Column, name: str) -> Column:
    """Top-level field of a parsed JSON object as text."""
    return F.try_variant_get(variant, f"$.{name}", "string")


def field_kind(variant: Column, name: str) -> Column:
    """JSON type of a top-level field: BOOLEAN, STRING, BIGINT ..., null when it is absent."""
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))


def without_markers(reply: Column) -> Column:
    """Text after the last final-channel marker, then after the last analysis marker, any case."""
    text = F.regexp_replace(reply, r"(?is)\A.*assistantfinal", "")
    behind = strip(F.regexp_replace(text, r"(?is)\A.*assistantanalysis", ""))
    # most replies have neither markers nor white space at an end, and are not searched by a pattern
    ends = F.concat(F.left(reply, F.lit(1)), F.right(reply, F.lit(1)))
    return F.when(F.contains(F.lower(reply), F.lit("assistant")), behind).when(
        ends.rlike(r"[^\x21-\x7e]"), strip(reply)).otherwise(reply)


_FENCE = r"```(?:json)?\s*(.*?)```"


# Prose that begins with a letter and has one pair of braces, no other brackets and no fence
_ONE_IN_PROSE = r"\A[A-Za-z][^{}\[\]`]*(\{[^{}\[\]`]*\})[^{}\[\]`]*\z"


def plain_piece(text: Column) -> Column:
    """Struct ``piece, stage`` of a text without markers: the part that may be read and where it lies. All of it behind a
    bracket, the first block when the text starts with a fence, or the only braces in prose; null for all others."""
    inner = blank_as_null(F.regexp_extract(text, _ONE_IN_PROSE, 1))

    def found(piece: Column, stage: str) -> Column:
        return F.struct(piece.alias("piece"), F.lit(stage).alias("stage"))

    return (
        F.when(F.substring(text, 1, 1).isin("{", "["), found(text, "whole"))
        .when(F.startswith(text, F.lit("```")), found(strip(F.regexp_extract(text, "(?is)" + _FENCE, 1)), "fence"))
        .when(inner.isNotNull(), found(inner, "balanced"))
    )


def plain_result(strict: Column, stage: Column, value: Column) -> Column:
    """Struct ``value, json, stage`` of a strict text and its value, which may be null."""
    return F.struct(value.alias("value"), strict.alias("json"), stage.alias("stage"))


def parse_rest(text: Column, plain: Column) -> Column:
    """The plain result where there is one, else what the lenient parser finds, else stage raw."""
    hopeless = unreadable(text) | text.rlike(_ONLY_PROSE)
    slow = parse_leniently(F.when(plain["value"].isNull() & (text != "") & ~hopeless, text))
    found = F.struct(F.try_parse_json(slow["json"]).alias("value"), slow["json"].alias("json"),
                     F.coalesce(slow["stage"], F.lit("raw")).alias("stage"))
    return F.when(plain["value"].isNotNull(), plain).when(text.isNotNull(), found)


@F.arrow_udf(PARSED)
def parse_leniently(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        found = [pa.nulls(len(texts), pa.string())] * 2
    else:
        read = [(None, None) if text is None else parse_text(text) for text in texts.to_pylist()]
        found = [pa.array([r[i] for r in read], pa.string()) for i in (0, 1)]
    return pa.StructArray.from_arrays(found, ["json", "stage"])


def parse_text(text: str) -> tuple[str | None, str]:
    """Every way to find a value, in order, for one text without markers."""
    stages = (
        ("whole", lambda: [text]),
        ("fence", lambda: (m.group(1).strip() for m in re.finditer(_FENCE, text, re.I | re.S))),
        ("balanced", lambda: sorted(balanced_spans(text), key=len, reverse=True)),
    )
    for stage, pieces in stages:
        for piece in pieces():
            value = read_value(piece)
            if value is not None:
                return json_text(value), stage
    return None, "raw"


def json_text(value) -> str:
    """Strict JSON text of a value. Numbers that JSON lacks become strings, half of a surrogate pair a question mark."""
    return json.dumps(finite(value), ensure_ascii=False).encode("utf-8", "replace").decode()


def finite(value):
    if isinstance(value, float) and not math.isfinite(value):
        return json.dumps(value)
    if isinstance(value, list):
        return [finite(v) for v in value]
    return {k: finite(v) for k, v in value.items()} if isinstance(value, dict) else value


@F.arrow_udf(StringType())
def reread(objects: pa.Array) -> pa.Array:
    """Strict JSON texts of what Python's reader accepts: also NaN, infinities and repeated keys, the last of which counts.

    The texts of a row come and go as one JSON object, as Spark measures an Arrow batch of arrays anew for every row.
    """
    if objects.null_count == len(objects):
        return pa.nulls(len(objects), pa.string())
    return pa.array([None if texts is None else json.dumps(
        {name: reread_text(text) for name, text in json.loads(texts).items()}) for texts in objects.to_pylist()], pa.string())


def reread_text(text: str) -> str | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return None if value is None else json_text(value)


def read_value(text: str):
    """Strict JSON, else JSON without commas before closing brackets, else a Python dict or list."""
    repaired = re.sub(r",\s*([}\]])", r"\1", text)
    for candidate in (text, repaired) if repaired != text else (text,):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
        except RecursionError:
            break
    if text[:1] not in tuple("{[(#\\"):  # no other text can read as a dict or list
        return None
    try:
        value = ast.literal_eval(text)
        json.dumps(value)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    return value if isinstance(value, (dict, list)) else None


def balanced_spans(text: str) -> list[str]:
    """From every opening bracket, the text up to where it closes; quoted text is skipped whole,
    and a quote that never ends leaves its bracket without a span.

    A bracket met on the way from another one closes where it does on that way, so it is not followed again.
    """
    spans = []
    for opener, closer in ("{}", "[]"):
        token = re.compile(rf"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|["']|[{re.escape(opener + closer)}]""", re.S)
        met, found = set(), []
        for start in (m.start() for m in re.finditer(re.escape(opener), text)):
            if start in met:
                continue
            still_open = []
            for m in token.finditer(text, start):
                if m.group(1):
                    continue
                if m.group() in "\"'":
                    break
                if m.group() == opener:
                    still_open.append(m.start())
                    met.add(m.start())
                else:
                    found.append((still_open.pop(), m.end()))
                    if not still_open:
                        break
        spans += [text[a:b] for a, b in sorted(found)]
    return spans


def between_last_braces(reply: Column) -> Column:
    """From the last opening brace to the last closing brace behind it, or null."""
    return blank_as_null(F.regexp_extract(reply, r"(\{[^{]*\})[^{}]*\z", 1))


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# The simple rules name the texts that may be the reply's JSON, in order.

def in_last_braces(reply: Column) -> list[Column]:
    """The final channel when it is marked, then the text in the last braces."""
    marked = F.when(F.contains(reply, F.lit("assistantfinal")), strip(final_channel(reply)))
    return [marked, between_last_braces(reply)]


def from_last_brace(reply: Column) -> list[Column]:
    """The text from the last opening brace to the end; a reply without braces gets one in front."""
    return [F.concat(F.lit("{"), F.substring_index(reply, "{", -1))]


def in_final_channel(reply: Column) -> list[Column]:
    """The final channel, with Python's True and False read as JSON."""
    return [F.replace(F.replace(final_channel(reply), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))]


def as_it_is(reply: Column) -> list[Column]:
    return [reply]


def text_fields(variant: Column, names: list[str], kinds: bool = True) -> Column:
    """Struct with the text of each named field and, as ``kinds``, their JSON types, which cost as much again."""
    texts = [field(variant, name).alias(name) for name in names]
    return F.struct(*texts, *([F.struct(*[field_kind(variant, name).alias(name) for name in names]).alias("kinds")] if kinds else []))


def all_or_nothing(fields: Column, names: list[str], missing: str = "N/A") -> dict[str, Column]:
    """The named fields of ``text_fields``; one absent field makes every field ``missing``."""
    complete = F.lit(True)
    for name in names:
        complete = complete & fields["kinds"][name].isNotNull()
    return {
        name: F.when(complete, F.coalesce(fields[name], F.lit(missing))).otherwise(F.lit(missing))
        for name in names
    }


def list_strings(value: Column) -> Column:
    """The stripped non-blank strings of a JSON list."""
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"),
                     lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(items, lambda v: strip(F.try_variant_get(v, "$", "string")))
    return F.filter(texts, lambda t: t != "")


def scoring_text(text: Column, value: Column, parsed: Column, fields: Column) -> Column:
    """Text fit for grading: the first filled answer key of a parsed object, the joined strings of a
    list, '' for JSON without either, and the reply itself when it is not JSON at all.

    ``text`` is the reply without markers, ``value`` its JSON as variant and ``parsed`` as text, ``fields`` the ``text_fields`` of the
    answer keys.
    """
    answers = [
        F.when((fields["kinds"][key] == "STRING") & (strip(fields[key]) != ""), strip(fields[key]))
        for key in ANSWER_KEYS
    ]
    structured = (F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))) | F.contains(
        text, F.lit("summarised_final_answer")
    )
    return (
        F.when(F.startswith(parsed, F.lit("{")), F.coalesce(*answers, F.lit("")))
        .when(F.startswith(parsed, F.lit("[")), F.array_join(list_strings(value), "\n"))
        .when(parsed.isin("true", "false"), F.initcap(parsed))
        .when(parsed.isNotNull(), F.coalesce(F.try_variant_get(value, "$", "string"), parsed))
        .when(structured, F.lit(""))
        .otherwise(text)
    )
