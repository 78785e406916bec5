"""Exact deduplication by a streaming query with disk-backed keyed state.

The documents are written once as a content table; ``row`` numbers its rows and so locates a content. A
streaming query folds the table into RocksDB state, one entry per digest and without expiry: the identifier
and locator of the row that stays, and the number of rows seen. The state is then read as a table. Wherever a
digest was hit more than once, the full normalised texts are compared with that of the row that stays; rows
that share only the digest are grouped by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrain.llm.shared import bit_set, shared_folder, stored, text_of, with_maybe
from voicegrain.operators.skew import skew_join

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOUNDED = {
    # many small stores: no space is set aside ahead of what they write
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def normalised(text: Column) -> Column:
    """The text without space and the controls 9 to 13; null counts as empty."""
    return F.translate(text_of(text), " \t\n\x0b\x0c\r", "")


def content_table(docs: DataFrame, key: str, text: str, digest) -> DataFrame:
    """``doc`` (all columns), ``row``, ``id``, ``points``, ``sha`` and ``digest``, stored in the shared folder."""
    plain = normalised(F.col(f"`{text}`"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.char_length(text_of(F.col(f"`{text}`"))).cast("bigint").alias("points"),
        F.sha2(plain, 256).alias("sha"),
    )
    return stored(rows.withColumn("digest", digest(F.col("sha"))))


def fold_into_state(content: DataFrame, path: str, state_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the streaming query over all files not seen yet and return the state:
    ``digest, n, keep_row, keep_id``. Most code points stay, then the smallest id (null last), then the first row."""
    spark = content.sparkSession
    narrow = content.select("digest", "points", "id", "row")
    reader = spark.readStream.schema(narrow.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    best = F.max(F.struct(
        "points", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("id_down"),
        F.bitwise_not("row").alias("row_down"),
    ))
    kept = reader.parquet(path).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, *BOUNDED)}
    for k, v in {PROVIDER: ROCKSDB, **BOUNDED}.items():
        spark.conf.set(k, v)
    try:
        query = (
            kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(state_dir)
        best, n = [F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields]
        return stored(state.select(
            F.col("key.digest"), n.alias("n"), F.bitwise_not(best["row_down"]).alias("keep_row"),
            F.bitwise_not(best["id_down"]).alias("keep_id"),
        ))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def false_hits(content: DataFrame, state: DataFrame, text: str) -> DataFrame:
    """Rows whose normalised text differs from that of the row their digest would keep."""
    hit = state.where("n > 1")
    suspects = stored(
        with_maybe(content.select("row", "digest", "id", "points", "doc"), "digest", bit_set(hit, "digest"), "_hit")
        .where("_hit").select("row", "digest", "id", "points", normalised(F.col(f"doc.`{text}`")).alias("plain"))
    )
    keepers = suspects.join(hit.select(F.col("keep_row").alias("row")), "row", "left_semi").select(
        "digest", F.col("plain").alias("keep_plain")
    )
    return stored(skew_join(suspects, keepers, "digest", ["row"]).where("plain != keep_plain").drop("keep_plain"))


def dedup_exact(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest=lambda sha: sha, files_per_batch: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The content table, and for each of its rows ``row, keep_id, group_size, kept``.

    Null and empty texts, and texts of white space alone, are equal. Of equal texts the row with the most code points
    stays, then the smallest id; null ids come last, and of wholly repeated rows just one stays. An empty table gives
    no rows. Other columns of ``docs``, whatever their names, stay inside ``doc``. ``digest`` maps the SHA-256 to
    the key of the state; a weak one costs comparisons, not results.
    """
    spark = docs.sparkSession
    content = content_table(docs, key, text, digest)
    path = content.inputFiles()[0].rsplit("/", 1)[0]
    state = fold_into_state(content, path, shared_folder(spark), files_per_batch)
    wrong = false_hits(content, state, text)
    placed = skew_join(content.select("row", "digest"), state, "digest", ["row"])
    if not wrong.isEmpty():
        own = Window.partitionBy("digest", "plain")
        order = own.orderBy(F.desc("points"), F.asc_nulls_last("id"), "row")
        split = wrong.select(
            "row", F.count(F.lit(1)).over(own).alias("own_n"), F.first("row").over(order).alias("own_row"),
            F.first("id").over(order).alias("own_id"),
        )
        less = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        placed = placed.join(less, "digest", "left").join(split, "row", "left").select(
            "row", F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0))).alias("n"),
            F.when(F.col("own_row").isNull(), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
            F.coalesce("own_row", "keep_row").alias("keep_row"),
        )
    return content, placed.select(
        "row", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept")
    )


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    content, placed = dedup_exact(docs, **options)
    return content.select("row", "id", "sha").join(placed, "row").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Only rows that may go meet the list of those that go.

    Null texts count as empty, and all texts that are empty but for white space are one group. Rows that are equal in
    every column are a group too, of which one stays; an empty table gives no rows.
    """
    content, placed = dedup_exact(docs, **options)
    gone = stored(placed.where(~F.col("kept")).select("row"))
    flagged = with_maybe(content.select("row", "doc"), "row", bit_set(gone, "row"), "_maybe")
    sure = flagged.where(~F.col("_maybe")).select("doc")
    rest = flagged.where("_maybe").join(gone, "row", "left_anti").select("doc")
    return sure.unionByName(rest).select("doc.*")
