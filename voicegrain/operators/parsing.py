"""Reply tables to typed columns, each reply read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.functions.json_replies import (
    as_strict, field_kind, in_final_channel, maybe_strict, parse_rest, plain_piece, plain_result, reread, scoring_text, strict_json, text_fields, unsettled,
    without_markers,
)
from voicegrain.lookups import ANSWER_KEYS
from voicegrain.operators.once import compute_once


def read_strict(df: DataFrame, texts: list[Column]) -> DataFrame:
    """Adds for each text, numbered from 0: ``_first0``, the number of the first text equal to it, null for a null; and
    ``_value0``, at that number, the variant of a text that is JSON.

    Equal texts are parsed once. The few that look strict but are not, because of a repeated key or a number like NaN, are
    read again in Python, all texts of a row in one pass.
    """
    columns = df.columns
    for i, column in enumerate(texts):  # one by one: the JVM never compiles the code of a long step
        df = compute_once(df, f"_text{i}", column)
        text = F.col(f"_text{i}")
        place = F.when(text.isNotNull(), F.lit(i))
        for j in reversed(range(i)):
            place = F.when(text == F.col(f"_text{j}"), F.lit(j)).otherwise(place)
        df = compute_once(df, f"_first{i}", place)
        df = compute_once(df, f"_maybe{i}", F.when(F.col(f"_first{i}") == i, maybe_strict(text)))
        df = compute_once(df, f"_strict{i}", strict_json(F.col(f"_maybe{i}")))
    rest = [unsettled(F.col(f"_maybe{i}"), F.col(f"_strict{i}")) for i in range(len(texts))]
    df = compute_once(df, "_rest", F.to_json(numbered(rest)))
    df = compute_once(df, "_again", F.from_json(reread(F.nullif("_rest", F.lit("{}"))), "map<string,string>"))
    for i in range(len(texts)):
        df = compute_once(df, f"_value{i}", F.coalesce(F.col(f"_strict{i}"), F.try_parse_json(F.col("_again")[str(i)])))
    kept = [f"_{name}{i}" for name in ("first", "value") for i in range(len(texts))]
    return df.select(*[name for name in df.columns if name in columns or name in kept])


def numbered(columns: list[Column]) -> Column:
    """A struct of the columns with their numbers as names."""
    return F.struct(*[column.alias(str(i)) for i, column in enumerate(columns)])


def taken(name: str, place: Column, upto: int) -> Column:
    """The column of this name with the number ``place``, which is ``upto`` at most."""
    found = F.when(place == 0, F.col(f"{name}0"))
    for i in range(1, upto + 1):
        found = found.when(place == i, F.col(f"{name}{i}"))
    return found


def read_json(df: DataFrame, reply: str, text: str = "_text", out: str = "_read") -> DataFrame:
    """Adds the reply without markers and its ``value, json, stage``, found in any of the known places."""
    df = compute_once(df, text, without_markers(F.col(reply)))
    df = compute_once(df, "_piece", plain_piece(F.col(text)))
    df = compute_once(df, "_json", as_strict(F.col("_piece")["piece"]))
    df = compute_once(df, "_maybe", maybe_strict(F.col("_json")))
    df = compute_once(df, "_value", strict_json(F.col("_maybe")))
    plain = plain_result(F.col("_json"), F.col("_piece")["stage"], F.col("_value"))
    return compute_once(df, out, parse_rest(F.col(text), plain)).drop("_piece", "_json", "_maybe", "_value")


def parse_replies(df: DataFrame, names: list[str], reply: str = "response", out: str = "parsed", kinds: bool = True) -> DataFrame:
    """Adds a struct ``out``: the named fields as text, their ``kinds`` if asked for, and the parse ``stage``.

    The stage tells where the value was found: whole, fence or balanced brackets; raw when nowhere.
    """
    read = read_json(df, reply)
    return with_fields(read, F.col("_read.value"), names, out, kinds, stage=F.col("_read.stage")).drop("_read", "_text")


def with_fields(df: DataFrame, value: Column, names: list[str], out: str, kinds: bool = True, **more: Column) -> DataFrame:
    """Adds the named fields of a variant as struct ``out``."""
    fields = text_fields(value, names, kinds)
    extra = [column.alias(name) for name, column in more.items()]
    shown = [*names, "kinds"] if kinds else names
    return compute_once(df, out, F.struct(*[fields[n].alias(n) for n in shown], value.isNotNull().alias("found"), *extra))


def parse_by(df: DataFrame, rule, names: list[str], reply: str = "response", out: str = "parsed", kinds: bool = True) -> DataFrame:
    """Like ``parse_replies`` with one of the simple rules (``in_last_braces``, ``from_last_brace``,
    ``in_final_channel``, ``as_it_is``); ``found`` is false where the rule finds no JSON."""
    return parse_by_rules(df, {out: rule}, names, reply, kinds=(out,) if kinds else ())


def parse_by_rules(df: DataFrame, rules: dict, names: list[str], reply: str = "response", kinds: tuple[str, ...] = ()) -> DataFrame:
    """Adds what each of several simple rules finds, as a struct by the rule's name, and the ``kinds`` for those named there.

    A text that several rules name is read once for all of them.
    """
    texts, places = [], {}
    for out, rule in rules.items():
        listed = rule(F.col(reply))
        places[out] = range(len(texts), len(texts) + len(listed))
        texts += listed
    read = read_strict(df, texts)
    for i in range(len(texts)):
        read = compute_once(read, f"_fields{i}", text_fields(F.col(f"_value{i}"), names, kinds=False))
    for out in rules:
        first = [F.col(f"_first{i}") for i in places[out]]
        at = [F.when(taken("_value", place, i).isNotNull(), place) for place, i in zip(first, places[out])]
        read = compute_once(read, "_at", F.coalesce(*at))
        fields = compute_once(read, "_taken", taken("_fields", F.col("_at"), places[out][-1]))
        value = taken("_value", F.col("_at"), places[out][-1])
        kind = [F.struct(*[field_kind(value, name).alias(name) for name in names]).alias("kinds")] if out in kinds else []
        found = F.struct(*[F.col("_taken")[name].alias(name) for name in names], *kind, F.col("_at").isNotNull().alias("found"))
        read = compute_once(fields, f"_found_{out}", found).drop("_at", "_taken")
    return read.select(*df.columns, *[F.col(f"_found_{out}").alias(out) for out in rules])


def with_scoring_text(df: DataFrame, reply: str = "response", out: str = "scoring_text") -> DataFrame:
    """Adds the gradable text of each reply; null for a null reply."""
    read = with_fields(read_json(df, reply), F.col("_read.value"), ANSWER_KEYS, "_fields")
    text = scoring_text(F.col("_text"), F.col("_read.value"), F.col("_read.json"), F.col("_fields"))
    return read.withColumn(out, F.when(F.col(reply).isNotNull(), text)).drop("_text", "_read", "_fields")


def useful_posts(labelled: DataFrame, reply: str = "response") -> DataFrame:
    """Posts whose reply calls them useful (the JSON value true), with ``description``."""
    parsed = parse_by(labelled, in_final_channel, ["UsefulInformation", "UserInformation"], reply)
    useful = (F.col("parsed.kinds.UsefulInformation") == "BOOLEAN") & (F.col("parsed.UsefulInformation") == "true")
    return parsed.where(useful).withColumn("description", F.col("parsed.UserInformation")).drop("parsed")


def flag(parsed: Column, name: str) -> Column:
    """A JSON boolean field as boolean; null for anything else."""
    return F.when(parsed["kinds"][name] == "BOOLEAN", parsed[name] == "true")
