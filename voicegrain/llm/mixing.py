"""Mixing sources to target weights as a curriculum over training time.

A source's schedule gives its weight at knots of training time 0 to 1, linear in between; its integral is the
source's weight in the mix. Targets share the budget by these weights and stop at a number of passes over the
source. A source's documents lie one after another in hash order on an axis of words, once for each pass; the
part of that axis below its target is taken. The schedule's running integral says how much of the target is
demanded by any time, and its inverse turns a place on the axis into a position in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrain.llm.shared import WORD, running_total, stored, text_of
from voicegrain.operators.skew import lookup_join


def n_words(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def ramps(rank: Column) -> Column:
    """Knots of the standard curriculum: weights 1, 2, 3, repeating by the source's rank; sources take turns in
    rising from half to one and a half of their weight and in falling by as much, so the integral is the weight."""
    weight = (rank % 3 + 1).cast("double")
    early, late = F.when(rank % 2 == 0, weight * 0.5).otherwise(weight * 1.5), F.when(
        rank % 2 == 0, weight * 1.5
    ).otherwise(weight * 0.5)
    return F.array(
        F.struct(F.lit(0.0).alias("at"), early.alias("weight")), F.struct(F.lit(1.0).alias("at"), late.alias("weight"))
    )


def with_integrals(knots: Column) -> Column:
    """``at, weight, until``: the integral of the schedule up to each knot."""
    empty = F.array().cast("array<struct<at:double,weight:double,until:double>>")

    def longer(done, knot):
        last = F.element_at(done, F.size(done))
        grown = last["until"] + (knot["at"] - last["at"]) * (knot["weight"] + last["weight"]) / 2
        until = F.when(F.size(done) == 0, F.lit(0.0)).otherwise(grown)
        return F.concat(done, F.array(F.struct(
            knot["at"].alias("at"), knot["weight"].alias("weight"), until.alias("until")
        )))

    return F.aggregate(knots, empty, lambda done, knot: F.when(F.size(done) == 0, F.array(F.struct(
        knot["at"].alias("at"), knot["weight"].alias("weight"), F.lit(0.0).alias("until")
    ))).otherwise(longer(done, knot)))


def when_demanded(curve: Column, share: Column) -> Column:
    """The time by which the schedule has asked for ``share`` (0 to 1) of its integral."""
    goal = share * F.element_at(curve, -1)["until"]
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(curve, lambda k: k["until"] <= goal)), F.size(curve) - 1))
    a, b = F.element_at(curve, i), F.element_at(curve, i + 1)
    width, rest = b["at"] - a["at"], goal - a["until"]
    slope = (b["weight"] - a["weight"]) / width
    # a.weight * x + slope * x^2 / 2 = rest, in the form that is stable for any slope
    root = F.sqrt(F.greatest(a["weight"] * a["weight"] + 2 * slope * rest, F.lit(0.0)))
    below = a["weight"] + root
    return a["at"] + F.when(below > 0, F.least(2 * rest / below, width)).otherwise(F.lit(0.0))


def source_plan(sized: DataFrame, schedule=ramps, budget: float = 1.0, most_passes: int = 3) -> DataFrame:
    """``source, source_size, target, curve`` for each source; one row per source goes through the windows.

    The budget is a share of all words. A target stops at ``most_passes`` times its source; the excess is
    shared by weight among the others until none is above. All sources full: the mix stays below the budget.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))) - 1
    plan = totals.withColumn("curve", with_integrals(schedule(rank))).withColumn(
        "_w", F.element_at("curve", -1)["until"]
    )
    cap = F.col("source_size") * F.lit(float(most_passes))
    plan = plan.withColumns({"_cap": cap, "_full": F.when(F.col("_w") > 0, cap / F.col("_w"))})
    # sources fill up in the order of _full; the level of the rest is found where the next would not fill
    order = Window.orderBy(F.asc_nulls_last("_full"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    plan = plan.withColumns({
        "_budget": F.sum("source_size").over(every) * F.lit(float(budget)),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = F.when(F.col("_left") > 0, (F.col("_budget") - F.col("_before")) / F.col("_left"))
    found = F.when(level <= F.col("_full"), F.struct("_full", level.alias("level")))
    plan = plan.withColumn("_level", F.min(found).over(every)["level"])
    target = F.when(F.col("_level").isNull(), F.when(F.col("_w") > 0, F.col("_cap"))).otherwise(
        F.least(F.col("_cap"), F.col("_level") * F.col("_w"))
    )
    return plan.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "curve")


def assign(
    docs: DataFrame, keys: list[str], size: Column, schedule=ramps, budget: float = 1.0, most_passes: int = 3,
    source: str = "source",
) -> DataFrame:
    """Columns of ``docs`` with ``size, source_size, target, taken`` and ``positions``, one for each copy taken.

    ``keys`` set a row's place within its source; rows that are equal in them are told apart by nothing, and their
    order among each other has no effect on the sums. The copy that the target cuts counts only the words below it.
    Documents without words are never taken. A null source is a source of its own; an empty table gives no rows.
    """
    rows = docs.withColumns({"size": size, "source": F.col(f"`{source}`")})
    plan = source_plan(rows, schedule, budget, most_passes)
    placed = running_total(rows, ["source"], keys, F.col("size"), "_at")
    on = F.col("l.source").eqNullSafe(F.col("r.source"))
    joined = lookup_join(placed.alias("l"), plan.alias("r"), on).select("l.*", "r.source_size", "r.target", "r.curve")
    goal = F.round("target").cast("bigint")
    span = F.greatest(F.col("source_size"), F.lit(1))
    copies = F.transform(F.sequence(F.lit(0), F.lit(most_passes)), lambda p: F.struct(
        (p * F.col("source_size") + F.col("_at")).alias("start"),
        F.least(F.col("size"), F.greatest(F.lit(0), goal - p * F.col("source_size") - F.col("_at"))).alias("words"),
    ))
    joined = joined.withColumn("_copies", F.filter(copies, lambda c: c["words"] > 0)).drop("_at")
    middle = F.transform("_copies", lambda c: when_demanded(
        F.col("curve"), F.least((c["start"] + c["words"] / 2) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    ))
    return joined.withColumns({
        "taken": F.aggregate("_copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]), "positions": middle,
    }).drop("_copies", "curve")


def narrow(docs: DataFrame, key: str, text: str, source: str, name: Column) -> DataFrame:
    """``doc_id, source, words, name`` of each row. Stored, so words are counted once."""
    return stored(docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        n_words(F.col(f"`{text}`")).alias("words"), name.alias("name"),
    ))


def name_of(key: str, text: str, source: str, others: list[str] = ()) -> Column:
    """What tells a row from others: its id, source and text, and its ``others`` columns."""
    parts = [F.col(f"`{key}`").cast("string"), F.col(f"`{source}`").cast("string"), F.sha2(text_of(F.col(f"`{text}`")), 256)]
    if others:
        parts.append(F.to_json(F.struct(F.col(f"`{text}`").isNull().alias("_no_text"), *[F.col(f"`{c}`") for c in others])))
    return F.sha2(F.to_json(F.array(*parts)), 256)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, positions`` for every document, sorted by its first position.

    A null text has no words. Null and repeated ids are rows of their own; other columns are left out.
    """
    placed = assign(narrow(docs, key, text, source, name_of(key, text, source)), ["name"], F.col("words"), **options)
    # documents that are not taken come after all positions, spread by their hash
    behind = 1 + F.pmod(F.xxhash64("name"), F.lit(1 << 20)) / (1 << 20)
    placed = placed.withColumn("_first", F.coalesce(F.get("positions", 0), behind))
    return placed.repartitionByRange("_first").sortWithinPartitions("_first", F.asc_nulls_last("doc_id")).select(
        "doc_id", "size", "source_size", "target", "taken", "positions"
    )


def training_order(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows of ``docs``, one for each copy taken (whole texts), range-sorted by training position.

    Keeps the columns of ``docs`` only; other names cannot clash, as they travel in one struct. Rows that
    are equal in every column are taken for the same row, repeated. Null and empty texts have no words and are never taken; an
    empty table gives no rows.
    """
    name = name_of(key, text, source, [c for c in docs.columns if c not in (key, text, source)])
    placed = assign(narrow(docs, key, text, source, name), ["name"], F.col("words"), **options)
    copies = stored(placed.select("name", "doc_id", F.explode("positions").alias("_at")))
    whole = docs.select(
        name.alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    ).groupBy("name").agg(F.any_value("_doc").alias("_doc"))
    rows = whole.join(copies, "name").select("_doc", "doc_id", "_at")
    return rows.repartitionByRange("_at").sortWithinPartitions("_at", F.asc_nulls_last("doc_id")).select("_doc.*")
