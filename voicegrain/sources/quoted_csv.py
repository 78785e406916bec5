"""CSV with quoted fields that hold line breaks, read in splits of any size.

Whether a line break ends a record depends on the quotes before it: an even number in the file so far, and it does. Files
are read as plain lines, which Spark splits by bytes, and the lines of a split are cut into short runs. Every run tells its number
of quotes, and how many records would begin in it if an even, or an odd, number of quotes came before; the parities and record
numbers at the start of each run are then running sums over runs, so no task has to hold a whole split. Lines that are whole records stay where they are; only lines of
records that go on over a line break, wherever a split cuts them, are gathered by record.

Quotes may only stand around whole fields and, doubled, inside them. Lines end in a line feed, with or without a carriage
return; where a file's first line has one, line breaks inside fields lose theirs, as in Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voicegrain.operators.once import compute_once

_RUN = ["_file", "_block", "_run"]

#: Lines of a run.
RUN_LINES = 1 << 13


def quotes_in(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def lines_of(spark: SparkSession, path: str | list[str], run_lines: int = RUN_LINES) -> DataFrame:
    """``value, _file, _block, _row, _run, _quotes, _empty, _return, _before``: lines with the quotes in them, and before them in
    their run. What is told of a line is told before lines are dealt by run, so its text goes along only where it is needed."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), quotes_in(F.col("value")).alias("_quotes"),
        F.col("value").isin("", "\r").alias("_empty"), F.endswith("value", F.lit("\r")).alias("_return"),
    ).withColumn("_run", F.expr(f"_row div {run_lines}"))
    ahead = Window.partitionBy(*_RUN).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("_before", F.coalesce(F.sum("_quotes").over(ahead), F.lit(0)))


def begins(parity: Column) -> Column:
    """Whether a record begins with the line, if so many quotes came before its run. Empty lines between records are none."""
    return ((F.col("_before") + parity) % 2 == 0) & ~F.col("_empty")


def run_starts(lines: DataFrame) -> DataFrame:
    """``_file, _block, _run, _parity, _records, _files, _returns``: quotes (odd or even) and records in the file before each run,
    the records of all files before, headers left out, and whether lines end in a carriage return too, as the file's
    first does. The running sums see one row per run and one per file."""
    sizes = lines.groupBy(*_RUN).agg(
        F.sum("_quotes").alias("_q"), F.count_if(begins(F.lit(0))).alias("_even"), F.count_if(begins(F.lit(1))).alias("_odd"),
        F.min_by("_return", "_row").alias("_return"))
    ahead = Window.partitionBy("_file").orderBy("_block", "_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        sizes.withColumn("_parity", F.coalesce(F.sum("_q").over(ahead), F.lit(0)) % 2)
        .withColumn("_n", F.when(F.col("_parity") == 0, F.col("_even")).otherwise(F.col("_odd")))
        .withColumn("_records", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = runs.groupBy("_file").agg(
        F.greatest(F.sum("_n") - 1, F.lit(0)).alias("_n"), F.min_by("_return", F.struct("_block", "_run")).alias("_returns")
    ).select("_file", "_returns", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_files"))
    return runs.select(*_RUN, "_parity", "_records").join(files, "_file")


def records_of(spark: SparkSession, path: str | list[str], run_lines: int = RUN_LINES) -> DataFrame:
    """``record, file, line, ord``: the records of all files but their headers, ``line`` numbered from 0 in each file and
    ``ord`` over all files by name."""
    lines = lines_of(spark, path, run_lines)
    placed = lines.drop("_return").join(run_starts(lines), _RUN)
    so_far = Window.partitionBy(*_RUN).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = begins(F.col("_parity"))
    inside = (F.col("_before") + F.col("_parity")) % 2 == 1
    numbered = placed.withColumns({
        "_no": F.col("_records") + F.sum(starts.cast("bigint")).over(so_far) - 1,
        "_whole": starts & (F.col("_quotes") % 2 == 0), "_kept": starts | inside,
    }).where("_kept and _no > 0")  # 0 is the header
    whole = numbered.where("_whole").select("_file", "_files", "_no", "value")
    ordered = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))
    joined = F.array_join(F.transform(ordered, lambda s: s["value"]), "\n")
    torn = numbered.where("not _whole").groupBy("_file", "_files", "_no", "_returns").agg(joined.alias("_all")).select(
        "_file", "_files", "_no", F.when(F.col("_returns"), F.replace("_all", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("_all")).alias("value"))
    return whole.unionByName(torn).select(
        F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value")).alias("record"),
        F.col("_file").alias("file"), (F.col("_no") - 1).alias("line"), (F.col("_files") + F.col("_no") - 1).alias("ord"),
    )


def read_records(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """The ``columns`` of the files, in their order there, as text, and ``file, line, ord`` as ``_file, _line, _ord``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    rows = compute_once(records_of(spark, path), "_csv", F.from_csv("record", F.lit(schema), options))
    return rows.select(*[F.col("_csv")[c].alias(c) for c in columns], F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("ord").alias("_ord"))
