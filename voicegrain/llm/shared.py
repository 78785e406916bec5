"""Tables in the cluster's shared folder, bounded bit sets, and running totals without a one-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space of the contracts: space and the controls 9 to 13. Words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A Spark bitmap holds so many bits (4 kB).
BITMAP = 32768
#: 256 bitmaps: a bit set is broadcast as 1 MB at most, whatever the size of the input.
BITS = 256 * BITMAP


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master without that setting gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="voicegrain-")
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/voicegrain-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches sent to Python workers hold about 4 MB, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 * 1024 * 1024)


def text_of(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def bit_set(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """A bounded superset of the keys as bitmaps ``_part, _bitmap``; aggregated on the map side."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select((bit / BITMAP).cast("int").alias("_part"), (bit % BITMAP).alias("_place"))
        .groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_bitmap"))
    )


def bit_at(bitmap: Column, place: Column) -> Column:
    """Whether the bit at ``place`` of a Spark bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1


def with_maybe(df: DataFrame, key: str, bitmaps: DataFrame, flag: str, bits: int = BITS) -> DataFrame:
    """Add ``flag``: false only if the row's key is surely not in the bit set."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = df.withColumn("_part", (bit / BITMAP).cast("int")).withColumn("_place", (bit % BITMAP).cast("int"))
    found = F.col("_bitmap").isNotNull() & bit_at(F.col("_bitmap"), F.col("_place"))
    return placed.join(F.broadcast(bitmaps), "_part", "left").withColumn(
        flag, F.coalesce(found, F.lit(False))
    ).drop("_part", "_place", "_bitmap")


def running_total(
    df: DataFrame, group: list[str], keys: list[str], size: Column, out: str, buckets: int = 4096, first: list[str] = ()
) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its group.

    Rows are ordered by the hash of ``first`` (if given, so that rows equal there stay near each other) and
    then of ``keys``, which identify a row within its group. The order is cut into ``buckets``; each bucket
    is summed by itself and starts from the total of those before, so no task meets a whole group.
    """
    parts = [F.pmod(F.xxhash64(*first), F.lit(256)).cast("int")] if first else []
    parts.append(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    names = [f"_b{i}" for i in range(len(parts))]
    sized = df.withColumns({"_size": size, **dict(zip(names, parts, strict=True))})
    ahead = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy(*group, *names).agg(F.sum("_size").alias("_sum")).withColumn(
        "_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))
    ).drop("_sum")
    within = Window.partitionBy(*group, *names).orderBy(F.xxhash64(*keys), *keys).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left, right = sized.alias("l"), starts.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, *names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    summed = left.join(right, on).select("l.*", "r._start").withColumn(
        out, F.col("_start") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    )
    return summed.drop("_size", "_start", *names)
